"""Plan-shape checks: the scale properties the design relies on."""
import contextlib
import io
import re

from pyspark.sql import functions as F

from events_helper import at, make_events
from secspark.operators import sequence as S
from secspark.operators.rules import SuspiciousProcess, WebAttack


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue().split("\n\n(")[0]


def test_per_event_rules_do_not_shuffle(spark, tmp_path):
    rows = [{"timestamp": at(i), "event_action": "http_request", "http_url": f"/x?q={i}'--", "http_user_agent": "a"}
            for i in range(20)]
    p = str(tmp_path / "ev")
    make_events(spark, rows).write.parquet(p)
    ev = spark.read.parquet(p)
    for rule in (WebAttack(), SuspiciousProcess()):
        assert "Exchange" not in _plan(rule.alerts(ev))


def test_forward_counts_shuffles_chunks_of_combined_ticks(spark):
    df = spark.createDataFrame([(f"k{i % 3}", i * 7) for i in range(100)], "k string, t long")
    plan = _plan(S.forward_counts(df, ["k"], "t", 10, chunks=5))
    # the windows over chunks, the sum per tick; the carries (a sum per chunk and key, a window over them, a broadcast)
    assert len(re.findall(r"\bExchange\b", plan)) == 4, plan
    assert len(re.findall("BroadcastExchange", plan)) == 1 and "SortMergeJoin" not in plan


def test_scan_reads_only_needed_columns(spark, tmp_path):
    p = str(tmp_path / "wide")
    spark.range(10).select(F.col("id"), (F.col("id") * 2).alias("a"), F.lit("x").alias("b"),
                           F.lit(1.5).alias("value")).write.parquet(p)
    from secspark.functions import scalar as X
    df = spark.read.parquet(p).select("id", X.severity_from_score("value").alias("s"))
    full = df._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", full).group(1)
    assert schema == "struct<id:bigint,value:double>"


def test_hot_key_spreads_over_tasks(spark):
    """One key holding every row is still windowed by several tasks."""
    df = spark.createDataFrame([("hot", i) for i in range(2000)], "k string, t long")
    prev = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keep the shuffle partitions as planned
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = S.forward_counts(df, ["k"], "t", 10)
        assert sum(bool(n) for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) == 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev[0])
        spark.conf.set("spark.sql.shuffle.partitions", prev[1])


def test_rules_read_their_own_partition_and_columns(spark, tmp_path):
    from secspark.plans.run import shared_events
    rows = [{"timestamp": at(i), "event_action": "http_request", "http_url": "/x"} for i in range(5)] + \
           [{"timestamp": at(i), "event_action": "process_create", "process_command_line": "mimikatz"} for i in range(5)]
    ev = shared_events(make_events(spark, rows))
    full = SuspiciousProcess().alerts(ev)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*event_action[^]]*process_create", full)
    assert ev.count() == 10


def test_travel_compiles(spark):
    """IT-001, its geo lookups and the legacy rule fit into generated code (no fall-back to the interpreter)."""
    from secspark.operators.legacy import legacy_impossible_travel, parse_legacy
    from secspark.operators.rules import ImpossibleTravel
    rows = [{"timestamp": at(hours=i), "event_action": "login", "event_outcome": "success", "user_name": "u",
             "source_ip": ("8.8.8.8", "1.2.3.4")[i % 2]} for i in range(4)]
    lines = spark.createDataFrame([(f'{{"timestamp": "2026-03-07T14:0{i}:00Z", "event_type": "login_success", "user": "u", '
                                    f'"ip": "{("8.8.8.8", "58.2.3.4")[i % 2]}"}}',) for i in range(4)], "value string")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert ImpossibleTravel().alerts(make_events(spark, rows)).count() == 3
        legacy_impossible_travel(parse_legacy(lines)).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
