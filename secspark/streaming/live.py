"""Structured Streaming variants (K1).

* Parse jobs and the per-event rules (SP-001, WA-001) are narrow projections,
  so the batch functions run unchanged on a ``readStream`` frame.
* BF-001, IT-001 and CS-001 need order within a key.  They are stateful processors
  (``transformWithState``, event time): a key keeps what is not yet decided in a map state, one entry per
  tick or login, and a timer for its oldest entry.  A batch touches the entries of its own rows; when the
  watermark passes the timer, the entries behind it are decided in order and removed.

What leaves the state, and when (nothing that could still change a result):

* BF-001: ticks, once the window they open has passed.  An idle key has no entry and no timer;
* CS-001: logins once the watermark has passed them; a failure's tick one window later;
* IT-001: logins once passed; a user's last login when even half the earth's circumference could be
  travelled below the speed limit since (:func:`travel_horizon_us`).

Rows behind the watermark are dropped by Spark; the delay is the ``watermark`` parameter, and
:class:`LateRows` adds up how many were lost over the whole run.  When a stream ends for good, the
``flush_*`` functions read the state that the stopped query left in its checkpoint and return what was
still open.  Stateful processors need the RocksDB state store: :func:`use_rocksdb`.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from ..functions import constants as K
from ..functions import scalar as X
from ..operators import parse as P
from ..operators.rules import BruteForce, CredentialStuffing, ImpossibleTravel
from ..operators.rules.base import event_fingerprint, pack_alerts
from ..operators.rules.brute_force import KEYS, failed_logins
from ..operators.rules.travel import located_logins

BURST_SCHEMA = ("source_ip string, user_name string, start_us long, end_us long, failed_attempts long, "
                "auth_methods array<string>, source_types array<string>, due timestamp")
TICK = "n long, auth_methods array<string>, source_types array<string>"
LOGIN = "us long, seq long, source_ip string, country string, fp string"
FOREVER = 1 << 62


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_stream(spark: SparkSession, directory: str, fmt: str, year: int | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Parsed events from log files arriving in ``directory`` (one format).

    Every batch's progress has the numbers of parsed and skipped records under ``observedMetrics["parse_<fmt>"]``.
    """
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = r.load(directory).withColumn("source_file", F.col("_metadata.file_path"))
    return P.parse(lines, fmt, year, counters=f"parse_{fmt}")


class LateRows(StreamingQueryListener):
    """Adds up the rows that stateful operators drop for being behind the watermark, over all batches.

    ``spark.streams.addListener(LateRows())``; ``total()`` of all queries, or ``total(query.id)``.
    """

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches[str(p.id)] = self.batches.get(str(p.id), 0) + 1
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self, query_id: str | None = None) -> int:
        return sum(n for q, n in self.rows.items() if query_id is None or q == str(query_id))


def _greedy_step(ticks: list[int], counts: list[int], horizon: int, window_us: int, threshold: int):
    """Decide every burst start that is final before ``horizon``: ((start, end, number) of ticks, ticks decided)."""
    out, i = [], 0
    while i < len(ticks) and ticks[i] + window_us < horizon:
        j = bisect.bisect_right(ticks, ticks[i] + window_us, lo=i)
        n = sum(counts[i:j])
        if n >= threshold:
            out.append((i, j, n))
            i = j
        else:
            i += 1
    return out, i


def _bursts(held: dict[int, tuple], horizon: int, window_us: int, threshold: int):
    """Bursts of a key's ticks (tick -> count, methods, sources) that are final: rows, and the ticks that are decided."""
    ticks = sorted(held)
    found, done = _greedy_step(ticks, [held[t][0] for t in ticks], horizon, window_us, threshold)
    rows = [(ticks[i], ticks[j - 1], n, sorted({m for t in ticks[i:j] for m in held[t][1]}),
             sorted({m for t in ticks[i:j] for m in held[t][2]}), pd.Timestamp((ticks[i] + window_us) * 1000))
            for i, j, n in found]
    return rows, ticks[:done]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class _Timed(StatefulProcessor):
    """One event-time timer per key, for the oldest thing that the key waits for."""

    def init(self, handle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms long")

    def wait_until(self, ms: int | None) -> None:
        """Move the key's timer (None: it waits for nothing)."""
        now = self.due.get()[0] if self.due.exists() else None
        if now == ms:
            return
        if now is not None and now in [t for t in self.handle.listTimers()]:
            self.handle.deleteTimer(now)
        if ms is None:
            self.due.clear()
        else:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        yield from self.settle(key, timerValues.getCurrentWatermarkInMs())

    def arrive(self, key, ms: int | None, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """After new rows, the oldest of which is final at ``ms``: decide, if the watermark is there already."""
        if ms is not None and ms <= watermark_ms:
            yield from self.settle(key, watermark_ms)
        elif ms is not None:
            self.wait_until(min(ms, self.due.get()[0]) if self.due.exists() else ms)

    def settle(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class BurstProcessor(_Timed):
    """BF-001: count, methods and sources per tick."""

    def __init__(self, window_us: int, threshold: int) -> None:
        self.window_us, self.threshold = window_us, threshold

    def init(self, handle) -> None:
        super().init(handle)
        self.ticks = handle.getMapState("ticks", "us long", TICK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest = None
        for pdf in rows:
            for us, g in pdf.groupby("us"):
                at = (int(us),)
                n, methods, sources = self.ticks.getValue(at) if self.ticks.containsKey(at) else (0, [], [])
                self.ticks.updateValue(at, (int(n) + len(g), sorted({*methods, *g["auth_method"]}),
                                            sorted({*sources, *g["source_type"]})))
                oldest = int(us) if oldest is None else min(oldest, int(us))
        yield from self.arrive(key, None if oldest is None else (oldest + self.window_us) // 1000 + 1,
                               timerValues.getCurrentWatermarkInMs())

    def settle(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        held = {int(k[0]): (int(v[0]), list(v[1]), list(v[2])) for k, v in self.ticks.iterator()}
        rows, done = _bursts(held, watermark_ms * 1000, self.window_us, self.threshold)
        for t in done:
            self.ticks.removeKey((t,))
        left = min(held.keys() - set(done), default=None)
        self.wait_until(None if left is None else max((left + self.window_us) // 1000 + 1, watermark_ms + 1))
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=_names(BURST_SCHEMA))


def stream_brute_force(events: DataFrame, threshold: int = 5, window_seconds: int = 600,
                       watermark: str = "10 minutes") -> DataFrame:
    """BF-001 bursts as an append-mode stream; ``due`` (start + window) is their event time."""
    use_rocksdb(events.sparkSession)
    f = failed_logins(events).withWatermark("timestamp", watermark).select(
        *KEYS, "timestamp", F.unix_micros("timestamp").alias("us"),
        F.coalesce(F.nullif("auth_method", F.lit("")), F.lit("unknown")).alias("auth_method"), "source_type")
    return f.groupBy(*KEYS).transformWithStateInPandas(
        BurstProcessor(int(window_seconds) * 1_000_000, threshold), BURST_SCHEMA, "Append", "EventTime",
        eventTimeColumnName="due")


def stream_brute_force_evidence(events: DataFrame, threshold: int = 5, window_seconds: int = 600,
                                watermark: str = "10 minutes") -> DataFrame:
    """E7 on a stream: the failed logins of each burst, by an interval join of the bursts with the events."""
    bursts = stream_brute_force(events, threshold, window_seconds, watermark).select(
        *[F.col(k).alias("b_" + k) for k in KEYS], "start_us", "end_us", "due")
    f = failed_logins(events).withWatermark("timestamp", watermark).select(
        *KEYS, "timestamp", F.unix_micros("timestamp").alias("us"), event_fingerprint().alias("event_fingerprint"))
    near = (F.col("timestamp") >= F.col("due") - F.expr(f"INTERVAL {int(window_seconds)} SECONDS")) & (F.col("timestamp") <= F.col("due"))
    same = [F.col(k) == F.col("b_" + k) for k in KEYS]
    return (f.join(bursts, [*same, near, F.col("us") >= F.col("start_us"), F.col("us") <= F.col("end_us")])
             .select(*KEYS, "start_us", "us", "event_fingerprint"))


def brute_force_alerts(bursts: DataFrame, rule: BruteForce | None = None) -> DataFrame:
    """Burst rows (streaming or flushed) in the common alert shape, as the batch rule describes them."""
    rule = rule or BruteForce()
    typed = rule.described(bursts.withColumns({"first_seen_ts": F.timestamp_micros("start_us"),
                                               "last_seen_ts": F.timestamp_micros("end_us")}))
    return pack_alerts(typed, rule.rule_id, rule.rule_name)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A state variable of a stopped query: its key columns, ``user_map_key`` and ``user_map_value`` or ``value``."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def _map_entries(spark: SparkSession, checkpoint: str, name: str, keys: list[str]) -> DataFrame:
    s = _state(spark, checkpoint, name)
    return s.select(*[F.col(f"key.{k}").alias(k) for k in keys], F.col("user_map_key").alias("k"), F.col("user_map_value").alias("v"))


def flush_brute_force(spark: SparkSession, checkpoint: str, threshold: int = 5, window_seconds: int = 600) -> DataFrame:
    """The bursts still open in the state of a stopped :func:`stream_brute_force` query, in its schema.

    A key's ticks are those of one window and the watermark's delay, so they fit in a group.
    """
    window_us = int(window_seconds) * 1_000_000
    ticks = _map_entries(spark, checkpoint, "ticks", KEYS).select(*KEYS, F.col("k.us").alias("us"), "v.*")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = {int(r.us): (int(r.n), list(r.auth_methods), list(r.source_types)) for r in pdf.itertuples()}
        rows, _ = _bursts(held, FOREVER, window_us, threshold)
        return pd.DataFrame([(*key, *r) for r in rows], columns=_names(BURST_SCHEMA))

    return ticks.groupBy(*KEYS).applyInPandas(run, BURST_SCHEMA)


TRAVEL_SCHEMA = ("user_name string, prev__us long, prev_source_ip string, prev_country string, prev__fp string, "
                 "_us long, source_ip string, country string, _fp string")


def travel_horizon_us(rule: ImpossibleTravel) -> int:
    """After so long, no two places are too far apart for the speed limit: half the circumference at that speed."""
    return math.ceil(math.pi * K.EARTH_RADIUS_KM / rule.max_speed_kmh * 3.6e9) + 1


class TravelProcessor(_Timed):
    """IT-001: the last decided login of a user, and the logins that the watermark has not passed."""

    def __init__(self, horizon_us: int) -> None:
        self.horizon_us = horizon_us

    def init(self, handle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "us long, n long", LOGIN)
        self.last = handle.getValueState("last", LOGIN)
        self.arrived = handle.getValueState("arrived", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = int(self.arrived.get()[0]) if self.arrived.exists() else 0
        oldest = None
        for pdf in rows:
            for r in pdf.sort_values("seq", kind="stable").itertuples():
                n += 1
                self.waiting.updateValue((int(r.us), n), (int(r.us), int(r.seq), r.source_ip, r.country, r.fp))
                oldest = int(r.us) if oldest is None else min(oldest, int(r.us))
        self.arrived.update((n,))
        yield from self.arrive(key, None if oldest is None else oldest // 1000 + 1, timerValues.getCurrentWatermarkInMs())

    def settle(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        held = sorted(((int(k[0]), int(k[1])), v) for k, v in self.waiting.iterator())
        last = self.last.get() if self.last.exists() else None
        rows = []
        for k, v in held:
            if k[0] >= watermark_ms * 1000:
                break
            if last is not None:
                rows.append((*key, last[0], last[2], last[3], last[4], v[0], v[2], v[3], v[4]))
            last = v
            self.waiting.removeKey(k)
        left = [k[0] for k, _ in held if k[0] >= watermark_ms * 1000]
        if last is not None and not left and int(last[0]) + self.horizon_us < watermark_ms * 1000:
            # No later login can be an impossible one: the user leaves the state.
            self.last.clear()
            self.arrived.clear()
            self.wait_until(None)
        else:
            if last is not None:
                self.last.update(tuple(last))
            ms = left[0] // 1000 + 1 if left else (int(last[0]) + self.horizon_us) // 1000 + 1
            self.wait_until(max(ms, watermark_ms + 1))
        if rows:
            yield pd.DataFrame(rows, columns=_names(TRAVEL_SCHEMA))


def _arrival(events: DataFrame):
    return F.col("ingest_seq") if "ingest_seq" in events.columns else F.lit(0).cast("long")


def stream_impossible_travel(events: DataFrame, rule: ImpossibleTravel | None = None,
                             watermark: str = "10 minutes") -> DataFrame:
    """IT-001 alerts on a stream."""
    rule = rule or ImpossibleTravel()
    use_rocksdb(events.sparkSession)
    e = located_logins(events.withColumn("seq", _arrival(events))).withWatermark("timestamp", watermark)
    e = e.select("user_name", "timestamp", F.unix_micros("timestamp").alias("us"), "seq", "source_ip", "country",
                 event_fingerprint().alias("fp"))
    pairs = e.groupBy("user_name").transformWithStateInPandas(
        TravelProcessor(travel_horizon_us(rule)), TRAVEL_SCHEMA, "Append", "EventTime")
    return travel_alerts(pairs, rule)


def travel_alerts(pairs: DataFrame, rule: ImpossibleTravel) -> DataFrame:
    pairs = pairs.withColumns({"prev_timestamp": F.timestamp_micros("prev__us"), "timestamp": F.timestamp_micros("_us")})
    return pack_alerts(rule.described(rule.judged(pairs)), rule.rule_id, rule.rule_name)


def flush_impossible_travel(spark: SparkSession, checkpoint: str, rule: ImpossibleTravel | None = None) -> DataFrame:
    """Alerts on the logins that a stopped :func:`stream_impossible_travel` query had not decided yet."""
    rule = rule or ImpossibleTravel()
    waiting = _map_entries(spark, checkpoint, "waiting", ["user_name"]).select("user_name", F.col("k.n").alias("n"), "v.*")
    last = _state(spark, checkpoint, "last").select("key.user_name", F.lit(0).cast("long").alias("n"), "value.*")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = list(pdf.sort_values(["us", "n"]).itertuples())
        rows = [(*key, a.us, a.source_ip, a.country, a.fp, b.us, b.source_ip, b.country, b.fp) for a, b in zip(r, r[1:], strict=False)]
        return pd.DataFrame(rows, columns=_names(TRAVEL_SCHEMA))

    return travel_alerts(waiting.unionByName(last).groupBy("user_name").applyInPandas(run, TRAVEL_SCHEMA), rule)


STUFFING_SCHEMA = "source_ip string, user_name string, _us long, _seq long, n long, first_us long"


def _hits(key, logins: list[tuple], failures: dict[int, int], window_us: int) -> list[tuple]:
    """Successes (us, seq, user, ok) in order that follow failures: rows; ``failures`` per tick grows on the way."""
    out = []
    for us, seq, user, ok in logins:
        if ok:
            near = [(t, n) for t, n in failures.items() if t >= us - window_us]
            if near:
                out.append((*key, user, us, seq, sum(n for _, n in near), min(near)[0]))
        else:
            failures[us] = failures.get(us, 0) + 1
    return out


class StuffingProcessor(_Timed):
    """CS-001: failures per tick within a window, and the logins that the watermark has not passed."""

    def __init__(self, window_us: int, own_seq: bool) -> None:
        self.window_us, self.own_seq = window_us, own_seq

    def init(self, handle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "us long, n long", "seq long, user_name string, ok boolean")
        self.failures = handle.getMapState("failures", "us long", "n long")
        self.arrived = handle.getValueState("arrived", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = int(self.arrived.get()[0]) if self.arrived.exists() else 0
        oldest = None
        for pdf in rows:
            for r in pdf.sort_values("seq", kind="stable").itertuples():
                n += 1
                user = None if pd.isna(r.user_name) else r.user_name
                self.waiting.updateValue((int(r.us), n), (n if self.own_seq else int(r.seq), user, bool(r.ok)))
                oldest = int(r.us) if oldest is None else min(oldest, int(r.us))
        self.arrived.update((n,))
        yield from self.arrive(key, None if oldest is None else oldest // 1000 + 1, timerValues.getCurrentWatermarkInMs())

    def settle(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        horizon = watermark_ms * 1000
        held = sorted(((int(k[0]), int(k[1])), v) for k, v in self.waiting.iterator())
        before = {int(k[0]): int(v[0]) for k, v in self.failures.iterator()}
        failures, past = dict(before), [(k, v) for k, v in held if k[0] < horizon]
        rows = _hits(key, [(k[0], int(v[0]), v[1], bool(v[2])) for k, v in past], failures, self.window_us)
        for k, _ in past:
            self.waiting.removeKey(k)
        # A tick can matter to successes up to one window after it, and those stand at the watermark or later.
        live = {t: n for t, n in failures.items() if t >= horizon - self.window_us}
        for t in before.keys() - live.keys():
            self.failures.removeKey((t,))
        for t, n in live.items():
            if before.get(t) != n:
                self.failures.updateValue((t,), (n,))
        left = [k[0] // 1000 + 1 for k, _ in held[len(past):][:1]] + [(t + self.window_us) // 1000 + 1 for t in sorted(live)[:1]]
        if not left:
            self.arrived.clear()
        self.wait_until(max(min(left), watermark_ms + 1) if left else None)
        if rows:
            yield pd.DataFrame(rows, columns=_names(STUFFING_SCHEMA))


def stream_credential_stuffing(events: DataFrame, rule: CredentialStuffing | None = None,
                               watermark: str = "10 minutes") -> DataFrame:
    """CS-001 alerts on a stream; logins of one moment count in the order of ``ingest_seq``, or of arrival."""
    rule = rule or CredentialStuffing()
    use_rocksdb(events.sparkSession)
    e = events.withColumn("seq", _arrival(events))
    e = e.filter((F.col("event_action") == "login") & (F.col("source_ip") != "")
                 & F.col("event_outcome").isin("success", "failure")).withWatermark("timestamp", watermark)
    e = e.select("source_ip", "timestamp", F.unix_micros("timestamp").alias("us"), "seq", "user_name",
                 (F.col("event_outcome") == "success").alias("ok"))
    hits = e.groupBy("source_ip").transformWithStateInPandas(
        StuffingProcessor(rule.window_us, "ingest_seq" not in events.columns), STUFFING_SCHEMA, "Append", "EventTime")
    return stuffing_alerts(hits, rule)


def stuffing_alerts(hits: DataFrame, rule: CredentialStuffing) -> DataFrame:
    return pack_alerts(rule.described(hits.withColumn("timestamp", F.timestamp_micros("_us"))), rule.rule_id, rule.rule_name)


def flush_credential_stuffing(spark: SparkSession, checkpoint: str, rule: CredentialStuffing | None = None) -> DataFrame:
    """Alerts on the logins that a stopped :func:`stream_credential_stuffing` query had not decided yet."""
    rule = rule or CredentialStuffing()
    window_us = rule.window_us
    waiting = _map_entries(spark, checkpoint, "waiting", ["source_ip"]).select(
        "source_ip", "k.us", F.col("k.n").alias("place"), "v.seq", "v.user_name", "v.ok", F.lit(1).cast("long").alias("n"))
    ticks = _map_entries(spark, checkpoint, "failures", ["source_ip"]).select(
        "source_ip", "k.us", F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("seq"),
        F.lit(None).cast("string").alias("user_name"), F.lit(None).cast("boolean").alias("ok"), "v.n")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        old = pdf[pdf["place"].isna()]
        failures = {int(r.us): int(r.n) for r in old.itertuples()}
        logins = [(int(r.us), int(r.seq), None if pd.isna(r.user_name) else r.user_name, bool(r.ok))
                  for r in pdf[pdf["place"].notna()].sort_values(["us", "place"]).itertuples()]
        return pd.DataFrame(_hits(key, logins, failures, window_us), columns=_names(STUFFING_SCHEMA))

    return stuffing_alerts(waiting.unionByName(ticks).groupBy("source_ip").applyInPandas(run, STUFFING_SCHEMA), rule)


def stream_alerts(events: DataFrame, rules=None) -> DataFrame:
    """Per-event rules on a stream (default SP-001 and WA-001), common alert shape."""
    from ..operators.rules import SuspiciousProcess, WebAttack, detect
    return detect(events, rules or [SuspiciousProcess(), WebAttack()])
