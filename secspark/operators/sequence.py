"""Per-key time-sequence operators that stay parallel when one key, or one moment, is hot.

The rules ask per-key questions over time: "how many failures from this key in the next W
seconds", "what was this user's previous login", "which greedy bursts does a key produce".  A plain
``Window.partitionBy(key)`` sends a key to one task, and a window per key and time bucket sends a
spike to one task.  Here time plays no part in the split: rows are range-partitioned by (key, order)
into chunks of about equal *row counts* (:func:`in_chunks`), and every question is put as running
sums and running last values (:func:`running`) in two levels:

1. inside a chunk, one window per (chunk, key), with running frames only;
2. between chunks, one row per (chunk, key) with the chunk's sum or last value; a window over
   those rows gives what a chunk is *carried* from the chunks before it.  Chunks are ranges, so at
   most one key runs on into a chunk: the carries are at most one row per chunk and
   direction, whatever the data, and are broadcast.

A count over ``[t, t + W]`` is then the difference of two running sums, one looked up by a probe row
that is sorted in at ``t + W``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

UNB = Window.unboundedPreceding
CUR = Window.currentRow
#: Chunks per shuffle partition: chunks are dealt to tasks by hash, so a task gets several small ones.
CHUNKS = 8


@dataclass
class Run:
    """A running value: the ``sum`` of a column, or the ``last`` one that is not null."""

    value: Column
    how: str = "sum"
    back: bool = False  # from a key's last row to its first
    own: bool = True  # does a row's own value count


def in_chunks(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """The rows with ``_chunk``: ranges of (keys, order) of about equal row counts, numbered in that order.

    Rows that tie in keys and order share a chunk.  Written to the shared folder, which fixes
    the numbers and cuts the lineage; a task writes several neighbouring chunks to one file.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(chunks or CHUNKS * parts, *[F.col(f"`{c}`") for c in [*keys, *order]])
    return stored(dealt.withColumn("_chunk", F.spark_partition_id()).coalesce(parts), "chunks")


def running(rows: DataFrame, keys: list[str], order: list[str], runs: dict[str, Run]) -> DataFrame:
    """Add running values per key, in ``order``, to the rows of :func:`in_chunks`."""
    part, place = ["_chunk", *keys], F.struct(*order)
    values = {name: f"_value_{k}" for k, name in enumerate(runs)}
    d = rows.withColumns({values[n]: r.value for n, r in runs.items()})

    def whole(name: str, r: Run) -> Column:
        v = F.col(values[name])
        if r.how == "sum":
            return F.sum(v).alias(name)
        at = F.when(v.isNotNull(), place)  # rows without a value do not count
        return (F.min_by(v, at) if r.back else F.max_by(v, at)).alias(name)

    of_chunk = d.groupBy(*part).agg(*[whole(n, r) for n, r in runs.items()])
    carries = {}
    for name, r in runs.items():
        before = Window.partitionBy(*keys).orderBy(F.desc("_chunk") if r.back else "_chunk").rowsBetween(UNB, -1)
        carries[f"_carry_{name}"] = F.sum(name).over(before) if r.how == "sum" else F.last(name, ignorenulls=True).over(before)
    carried = of_chunk.select(*part, *[c.alias(n) for n, c in carries.items()])
    carried = carried.filter(" or ".join(f"{n} is not null" for n in carries))
    carried = carried.select(*[F.col(c).alias(f"_at_{c}") for c in part], *carries)

    for back in (False, True):
        mine = {n: r for n, r in runs.items() if r.back is back}
        if not mine:
            continue
        w = Window.partitionBy(*part).orderBy(*[F.desc(c) if back else F.asc(c) for c in order])
        found = {}
        for name, r in mine.items():
            v, frame = F.col(values[name]), w.rowsBetween(UNB, CUR if r.own else -1)
            found[name] = F.sum(v).over(frame) if r.how == "sum" else F.last(v, ignorenulls=True).over(frame)
        d = d.withColumns(found)
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in part]
    out = d.join(F.broadcast(carried), same, "left")  # at most one row per chunk and direction
    none = F.lit(0)
    return out.select(*rows.columns, *[
        (F.coalesce(name, none) + F.coalesce(f"_carry_{name}", none) if r.how == "sum"
         else F.coalesce(name, f"_carry_{name}")).alias(name) for name, r in runs.items()])


# --------------------------------------------------------------------------
# Forward window counts: n(t) = #rows of the key with time in [t, t + W]
# --------------------------------------------------------------------------
def forward_counts(df: DataFrame, keys: list[str], us: str, window_us: int, chunks: int | None = None) -> DataFrame:
    """One row per key and distinct time: ``(keys, us, n)`` with ``n`` = rows of the key in ``[us, us + W]``.

    Rows are first counted per tick, with map-side combine: an attack that piles rows onto few
    ticks costs its distinct ticks, not its rows.  Each tick is sorted in twice, as itself and as a
    probe at ``t + W`` (after the tick of that time), and
    ``n = #(time <= t + W) - #(time < t)`` adds up the two running sums per tick.
    """
    t = F.col("_t")
    ticks = df.select(*keys, F.col(us).alias("_t")).groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_c"))

    def placed(time: Column, kind: int, weight: Column) -> Column:
        return F.struct(time.alias("_time"), F.lit(kind).alias("_kind"), weight.alias("_w"))

    both = F.array(placed(t, 0, F.col("_c")), placed(t + window_us, 1, F.lit(0).cast("bigint")))
    rows = in_chunks(ticks.select(*keys, t.alias("_o"), F.inline(both)), keys, ["_time", "_kind"], chunks)
    s = running(rows, keys, ["_time", "_kind"], {"_sum": Run(F.col("_w"))})
    part = F.when(F.col("_kind") == 1, F.col("_sum")).otherwise(F.col("_w") - F.col("_sum"))
    return s.groupBy(*keys, "_o").agg(F.sum(part).alias("n")).select(*keys, F.col("_o").alias(us), "n")


# --------------------------------------------------------------------------
# Greedy non-overlapping bursts (BF-001, G1)
# --------------------------------------------------------------------------
def greedy_bursts(df: DataFrame, keys: list[str], us: str, window_us: int, threshold: int,
                  chunks: int | None = None) -> DataFrame:
    """Start times of the bursts a greedy left-to-right scan picks, per key.

    Scan semantics: from the current row ``i`` the window holds every row with
    ``t_i <= t <= t_i + W``; with at least ``threshold`` rows it is a burst and
    the scan jumps past it, else it moves one row on.  Only ticks whose
    forward count reaches the threshold (*candidates*) can start a burst, and
    after a burst at ``t`` the next start is the first candidate after
    ``t + W``.  A candidate with no other candidate in ``[t - W, t)`` is always
    picked (a *head*); from each head the chain ``next(next(...))`` is
    followed by pointer doubling (:func:`_follow_chains`), so no group is ever
    collected into one row.

    Returns ``(keys, start_us, n)``.
    """
    cand = forward_counts(df, keys, us, window_us, chunks).filter(F.col("n") >= threshold)
    t = F.col(us)
    both = F.array(F.struct(t.alias("_time"), F.lit(0).alias("_kind"), t.alias("_ct")),
                   F.struct((t + window_us).alias("_time"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_ct")))
    order = ["_time", "_kind"]
    rows = in_chunks(cand.select(*keys, t.alias("_t"), "n", F.inline(both)), keys, order, chunks)
    # a candidate's previous one; a probe's next one, which stands after the candidate at t + W itself
    s = running(rows, keys, order, {"_prev": Run(F.col("_ct"), "last", own=False),
                                    "_next": Run(F.col("_ct"), "last", back=True, own=False)})
    nodes = s.groupBy(*keys, "_t").agg(
        F.max("n").alias("n"), F.max(F.when(F.col("_kind") == 0, F.col("_prev"))).alias("_prev"),
        F.max(F.when(F.col("_kind") == 1, F.col("_next"))).alias("_j"))
    nodes = nodes.withColumn("_head", F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > window_us))
    # A next start that is a head is picked anyway: its previous candidate lies more than W before it.
    heads = nodes.select(*keys, F.col("_t").alias("_j"), F.col("_head").alias("_stop"))
    nodes = nodes.join(heads, [*keys, "_j"], "left").select(
        *keys, "_t", "n", "_head", F.when(~F.col("_stop"), F.col("_j")).alias("_j"))
    return _follow_chains(nodes, keys).select(*keys, F.col("_t").alias("start_us"), "n")


def _follow_chains(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Heads plus every node reached from a head through ``_j`` pointers.

    Pointer doubling, smallest jump first.  ``reached`` holds the nodes less
    than ``2**k`` steps from a head; joining it with the ``2**k``-step jumps
    doubles that, and joining the jumps with themselves doubles the jumps.
    Both tables are written to the shared folder in every round, so each
    round plans two joins over two scans whatever the chain's length, and a
    chain of ``c`` bursts takes ``log2(c)`` rounds.  ``(key, t)`` is unique on
    both sides of every join, so no key is hot.
    """
    nodes = stored(nodes, "burst-nodes")
    jumps = nodes.filter(F.col("_j").isNotNull()).select(*keys, "_t", "_j")
    reached = nodes.filter("_head").select(*keys, "_t")
    while not jumps.isEmpty():
        step = reached.join(jumps, [*keys, "_t"]).select(*keys, F.col("_j").alias("_t"))
        reached = stored(reached.unionByName(step), "burst-reached")
        a, b = jumps.alias("a"), jumps.alias("b")
        same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
        jumps = stored(a.join(b, [*same, F.col("a._j") == F.col("b._t")])
                        .select(*[F.col(f"a.{k}") for k in keys], F.col("a._t"), F.col("b._j")), "burst-jumps")
    return reached.join(nodes.select(*keys, "_t", "n"), [*keys, "_t"])


def burst_members(rows: DataFrame, bursts: DataFrame, keys: list[str], us: str, window_us: int,
                  chunks: int | None = None) -> DataFrame:
    """Attach ``start_us`` of the burst each row belongs to (inner: members only).

    The bursts' starts are sorted in among the rows, and each row takes the last start before it:
    bursts of one key do not overlap, so no other can hold the row.  Not a join, so neither a key nor
    a moment with many rows is hot (``_tie`` spreads the rows of one moment).
    """
    payload = [c for c in rows.columns if c not in keys]
    r = rows.select(*keys, F.col(us).alias("_time"), F.lit(1).alias("_kind"), F.monotonically_increasing_id().alias("_tie"),
                    F.lit(None).cast("bigint").alias("_start"), F.struct(*payload).alias("_row"))
    b = bursts.select(*keys, F.col("start_us").alias("_time"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_tie"),
                      F.col("start_us").alias("_start"), F.lit(None).cast(r.schema["_row"].dataType).alias("_row"))
    order = ["_time", "_kind", "_tie"]
    s = running(in_chunks(r.unionByName(b), keys, order, chunks), keys, order, {"start_us": Run(F.col("_start"), "last")})
    s = s.filter((F.col("_kind") == 1) & (F.col("_time") <= F.col("start_us") + window_us))
    return s.select(*keys, "_row.*", "start_us").select(*rows.columns, "start_us")


# --------------------------------------------------------------------------
# Previous row per key (IT-001, legacy travel)
# --------------------------------------------------------------------------
def lag_by_key(df: DataFrame, keys: list[str], order: list[str], payload: list[str], prefix: str = "prev_",
               chunks: int | None = None) -> DataFrame:
    """Add ``prev_<col>`` for each payload column: the previous row of the same key (null for the first).

    A chunk's first row of a key takes the last row of the chunks before.
    """
    rows = in_chunks(df.withColumn("_tie", F.monotonically_increasing_id()), keys, [*order, "_tie"], chunks)
    s = running(rows, keys, [*order, "_tie"], {"_prev": Run(F.struct(*payload), "last", own=False)})
    return s.select(*df.columns, *[F.col(f"_prev.{c}").alias(prefix + c) for c in payload])


# --------------------------------------------------------------------------
# Trailing band counts (CS-001): events of one kind in [t - W, t) before each probe row
# --------------------------------------------------------------------------
def trailing_counts(df: DataFrame, keys: list[str], us: str, seq: str, is_probe: Column,
                    is_counted: Column, window_us: int, chunks: int | None = None) -> DataFrame:
    """For probe rows: ``n`` = counted rows earlier in (time, seq) order with
    ``time >= t - W``, and ``first_us`` = the earliest such time.

    A probe is sorted in twice: where it stands, and before every row of time ``t - W``.  The
    difference of the running counts is ``n``; the next counted time from the second place on is ``first_us``.
    """
    d = df.withColumn("_probe", is_probe).withColumn("_cnt", is_counted & ~F.col("_probe"))
    d = d.filter(F.col("_probe") | F.col("_cnt")).withColumn("_tie", F.monotonically_increasing_id())
    t, whole = F.col(us), F.struct(*[F.col(c) for c in df.columns if c not in keys])

    def placed(time: Column, kind: int, own_seq: Column, row: Column) -> Column:
        return F.struct(time.alias("_time"), F.lit(kind).alias("_kind"), own_seq.alias("_seq2"), row.alias("_row"))

    seq_type, row_type = d.schema[seq].dataType, d.select(whole.alias("r")).schema["r"].dataType
    none = F.lit(None).cast(row_type)
    here = placed(t, 1, F.col(seq), F.when(F.col("_probe"), whole).otherwise(none))
    back = placed(t - window_us, 0, F.lit(None).cast(seq_type), none)
    u = d.select(*keys, "_cnt", "_tie", F.inline(F.when(F.col("_probe"), F.array(here, back)).otherwise(F.array(here))))
    order = ["_time", "_kind", "_seq2", "_tie"]
    s = running(in_chunks(u, keys, order, chunks), keys, order, {
        "_sum": Run(F.col("_cnt").cast("bigint")),
        "_first": Run(F.when(F.col("_cnt"), F.col("_time")), "last", back=True)}).filter(~F.col("_cnt"))
    at = F.col("_kind") == 1
    n = s.groupBy("_tie").agg(F.sum(F.when(at, F.col("_sum")).otherwise(-F.col("_sum"))).alias("n"),
                              F.max(F.when(~at, F.col("_first"))).alias("first_us"),
                              *[F.max(F.when(at, F.col(k))).alias(k) for k in keys],
                              F.first(F.when(at, F.col("_row")), ignorenulls=True).alias("_row"))
    out = n.select(*keys, "_row.*", "n", F.when(F.col("n") > 0, F.col("first_us")).alias("first_us"))
    return out.select(*df.columns, "n", "first_us")


# --------------------------------------------------------------------------
# Next row of a kind within W (CS-001 evidence)
# --------------------------------------------------------------------------
def next_within(df: DataFrame, keys: list[str], us: str, seq: str, is_probe: Column, is_target: Column,
                payload: list[str], window_us: int, chunks: int | None = None) -> DataFrame:
    """For probe rows: ``next_<col>`` of the first target later in (time, seq) order, if it is within ``W``."""
    d = df.withColumn("_probe", is_probe).withColumn("_target", is_target & ~F.col("_probe"))
    d = d.filter(F.col("_probe") | F.col("_target")).withColumn("_tie", F.monotonically_increasing_id())
    order = [us, seq, "_tie"]
    target = F.when(F.col("_target"), F.struct(*[F.col(c) for c in payload]))
    s = running(in_chunks(d, keys, order, chunks), keys, order, {"_next": Run(target, "last", back=True)}).filter("_probe")
    near = F.col(f"_next.{us}") <= F.col(us) + window_us
    return s.select(*df.columns, *[F.when(near, F.col(f"_next.{c}")).alias("next_" + c.lstrip("_")) for c in payload])
