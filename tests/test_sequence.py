import random
import time

import pytest
from pyspark.sql import functions as F

from secspark.operators import sequence as S


def py_greedy(ts, W, T):
    ts = sorted(ts)
    out, i = [], 0
    while i < len(ts):
        j = i
        while j < len(ts) and ts[j] - ts[i] <= W:
            j += 1
        if j - i >= T:
            out.append((ts[i], j - i))
            i = j
        else:
            i += 1
    return out


def _random_rows(seed, keys=4, n=400, span=300):
    rnd = random.Random(seed)
    return [(f"k{rnd.randrange(keys)}", rnd.randrange(span)) for _ in range(n)]


def test_forward_counts_brute_force(spark):
    rows = _random_rows(1)
    df = spark.createDataFrame(rows, "k string, t long")
    got = {(r["k"], r["t"]): r["n"] for r in S.forward_counts(df, ["k"], "t", 10, chunks=7).collect()}
    want = {(k, t): sum(1 for k2, t2 in rows if k2 == k and t <= t2 <= t + 10) for k, t in set(rows)}
    assert got == want
    assert S.forward_counts(df, ["k"], "t", 10, chunks=7).count() == len(set(rows))  # one row per tick


def test_greedy_bursts_random(spark):
    for seed, W, T in [(2, 10, 2), (3, 10, 5), (4, 10, 9), (5, 3, 3)]:
        rows = _random_rows(seed, keys=3, n=300, span=400)
        df = spark.createDataFrame(rows, "k string, t long")
        got = sorted((r["k"], r["start_us"], r["n"]) for r in S.greedy_bursts(df, ["k"], "t", W, T, chunks=11).collect())
        want = sorted((k, t, n) for k in {r[0] for r in rows} for t, n in py_greedy([t for k2, t in rows if k2 == k], W, T))
        assert got == want, (seed, W, T)


def test_a_chain_of_a_thousand_bursts(spark):
    """Steady attack: every burst follows from the one before; neither time nor plan explodes."""
    ts = [k * 3 for k in range(4000)]
    df = spark.createDataFrame([("k", t) for t in ts], "k string, t long")
    began = time.time()
    out = S.greedy_bursts(df, ["k"], "t", 10, 3)
    got = sorted((r["start_us"], r["n"]) for r in out.collect())
    assert got == py_greedy(ts, 10, 3) and len(got) == 1000
    assert time.time() - began < 60
    joins = out._jdf.queryExecution().logical().toString().count("Join")
    assert joins <= 3


def test_a_spike_costs_its_ticks_not_its_rows(spark):
    """One key with nine tenths of the rows on a few ticks of one bucket."""
    rows = [("hot", 100 + i % 7) for i in range(18000)] + [(f"k{i}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t long").repartition(4)
    got = {(r["k"], r["t"]): r["n"] for r in S.forward_counts(df, ["k"], "t", 10).collect()}
    assert got["hot", 100] == 18000 and len(got) == 2007
    plan = S.forward_counts(df, ["k"], "t", 10)._jdf.queryExecution().executedPlan().toString()
    # the ticks are written before they are windowed, combined on the map side
    assert "partial_count" not in plan and plan.count("Window") >= 2


def test_next_within_brute_force(spark):
    rnd = random.Random(9)
    rows = [(f"ip{rnd.randrange(3)}", rnd.randrange(300), i, rnd.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, ok boolean")
    out = S.next_within(df, ["k"], "t", "seq", ~F.col("ok"), F.col("ok"), ["t", "seq"], 15, 9).collect()
    got = {r["seq"]: r["next_seq"] for r in out}
    want = {}
    for k, t, s, ok in rows:
        if not ok:
            later = sorted((t2, s2) for k2, t2, s2, ok2 in rows if k2 == k and ok2 and (t2, s2) > (t, s))
            want[s] = later[0][1] if later and later[0][0] <= t + 15 else None
    assert got == want and len(out) == len(want)


def test_lag_by_key_across_buckets(spark):
    rows = [(k, t, i) for i, (k, t) in enumerate(_random_rows(6, keys=3, n=120, span=1000))]
    df = spark.createDataFrame(rows, "k string, t long, seq long")
    got = {(r["k"], r["t"], r["seq"]): r["prev_seq"] for r in
           S.lag_by_key(df, ["k"], ["t", "seq"], ["seq"], chunks=13).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        seq = sorted((t, s) for k2, t, s in rows if k2 == k)
        for i, (t, s) in enumerate(seq):
            want[(k, t, s)] = seq[i - 1][1] if i else None
    assert got == want


def test_trailing_counts_brute_force(spark):
    rnd = random.Random(7)
    rows = [(f"ip{rnd.randrange(3)}", rnd.randrange(200), i, rnd.random() < 0.3) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, ok boolean")
    out = S.trailing_counts(df, ["k"], "t", "seq", F.col("ok"), ~F.col("ok"), 15, chunks=9)
    got = {r["seq"]: (r["n"], r["first_us"]) for r in out.collect()}
    want = {}
    for k, t, s, ok in rows:
        if ok:
            prior = [t2 for k2, t2, s2, ok2 in rows if k2 == k and not ok2 and (t2, s2) < (t, s) and t - t2 <= 15]
            want[s] = (len(prior), min(prior) if prior else None)
    assert got == want


SPIKE = 40_000  # rows of one key, all within one window of W


def _spike(spark):
    """A key that holds every row, on distinct ticks of a single window."""
    return spark.range(0, SPIKE, 1, 8).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % SPIKE).alias("t"),
                                              F.col("id").alias("seq"), (F.col("id") % 3 == 0).alias("ok"))


def _even(spark, rows, keys, order, runs):
    """Rows of each task that windows the chunks: none has over twice the median."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that tasks are the shuffle's partitions
    try:
        d = S.running(rows, keys, order, runs)
        sizes = sorted(d.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == rows.count() and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2], sizes


def test_one_key_in_one_window_is_spread_evenly(spark):
    d = _spike(spark)
    chunked = S.in_chunks(d, ["k"], ["t", "seq"])
    sizes = sorted(r["count"] for r in chunked.groupBy("_chunk").count().collect())
    assert len(sizes) > 20 and sizes[-1] <= 2 * sizes[len(sizes) // 2], sizes
    _even(spark, chunked, ["k"], ["t", "seq"], {"s": S.Run(F.lit(1).cast("bigint")), "p": S.Run(F.col("seq"), "last", own=False)})


def test_spike_results_of_every_operator(spark):
    """All rows of one key in one window: counts, bursts, members, previous rows, trailing counts, next rows."""
    d = _spike(spark)
    W = 10 * SPIKE
    n = S.forward_counts(d, ["k"], "t", W)
    assert n.filter(F.col("n") != SPIKE - F.col("t")).count() == 0 and n.count() == SPIKE
    bursts = S.greedy_bursts(d, ["k"], "t", W, 5)
    assert [tuple(r) for r in bursts.collect()] == [("hot", 0, SPIKE)]
    assert S.burst_members(d, bursts, ["k"], "t", W).filter("start_us = 0").count() == SPIKE
    lag = S.lag_by_key(d, ["k"], ["t"], ["t"])
    assert lag.filter(F.col("prev_t") == F.col("t") - 1).count() == SPIKE - 1
    c = S.trailing_counts(d, ["k"], "t", "seq", F.col("ok"), ~F.col("ok"), W)
    ok = d.filter("ok").count()
    assert c.count() == ok and c.agg(F.max("n")).first()[0] >= SPIKE - ok - 10
    assert S.next_within(d, ["k"], "t", "seq", ~F.col("ok"), F.col("ok"), ["t", "seq"], W).filter("next_t > t").count() > 0.6 * (SPIKE - ok)


def test_spike_on_one_tick(spark):
    """Rows that share a key and a moment are spread too, where an operator keeps rows."""
    d = spark.range(0, SPIKE, 1, 8).select(F.lit("hot").alias("k"), F.lit(100).cast("long").alias("t"), "id")
    assert [tuple(r) for r in S.forward_counts(d, ["k"], "t", 10).collect()] == [("hot", 100, SPIKE)]
    bursts = S.greedy_bursts(d, ["k"], "t", 10, 5)
    assert S.burst_members(d, bursts, ["k"], "t", 10).count() == SPIKE
    rows = S.in_chunks(d.withColumn("_tie", F.monotonically_increasing_id()), ["k"], ["t", "_tie"])
    _even(spark, rows, ["k"], ["t", "_tie"], {"s": S.Run(F.lit(1).cast("bigint"))})


def test_carries_are_one_row_per_chunk(spark):
    """What is broadcast does not grow with the keys: only a key that runs over a chunk's border is carried."""
    d = spark.range(0, 5000, 1, 4).select((F.col("id") % 1700).alias("k"), F.col("id").alias("t"))
    rows = S.in_chunks(d, ["k"], ["t"], 16)
    out = S.running(rows, ["k"], ["t"], {"s": S.Run(F.lit(1).cast("bigint")), "b": S.Run(F.col("t"), "last", back=True, own=False)})
    got = {(r["k"], r["t"]): (r["s"], r["b"]) for r in out.collect()}
    want = {(t % 1700, t): (t // 1700 + 1, t + 1700 if t + 1700 < 5000 else None) for t in range(5000)}
    assert got == want
    over = rows.groupBy("k").agg(F.countDistinct("_chunk").alias("c")).agg(F.sum(F.col("c") - 1)).first()[0]
    assert over <= 16
