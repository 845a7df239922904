"""Alert rollups and ordering.

All rollups are ``groupBy`` aggregates with map-side partial aggregation; their
outputs are tiny (one row per rule, severity or source type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .rules import RULES


def rule_order_col(rule_id="rule_id"):
    known = F.array(*[F.lit(r) for r in K.RULE_ORDER])
    pos = F.array_position(known, F.col(rule_id))
    return F.when(pos > 0, pos).otherwise(F.lit(len(K.RULE_ORDER) + 1))


def newest_first(alerts: DataFrame) -> DataFrame:
    """H1: newest first; ties broken by rule order and alert id (Spark sorts are not stable)."""
    return alerts.orderBy(F.col("timestamp").desc(), rule_order_col(), F.col("alert_id"))


def alert_samples(alerts: DataFrame) -> DataFrame:
    """H5: the newest alert of each rule."""
    w = Window.partitionBy("rule_id").orderBy(F.col("timestamp").desc(), F.col("alert_id"))
    return alerts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def by_severity(alerts: DataFrame) -> DataFrame:
    """F1."""
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n_alerts"))


def by_rule(alerts: DataFrame) -> DataFrame:
    """counts per rule with the documented true-positive prior and note on false positives."""
    prior = F.create_map(*[x for k, v in K.TRUE_POSITIVE_ESTIMATES.items() for x in (F.lit(k), F.lit(v))])
    note = F.create_map(*[F.lit(x) for text in K.FALSE_POSITIVE_NOTES for x in text.split(": ", 1)])
    return (alerts.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_alerts"))
                  .withColumn("true_positive_estimate", prior[F.col("rule_id")])
                  .withColumn("false_positive_note", note[F.col("rule_id")]).orderBy("rule_id"))


def by_source_type(events: DataFrame) -> DataFrame:
    """F3 (H4: rows sorted by source type)."""
    return events.groupBy("source_type").agg(F.count(F.lit(1)).alias("n_events")).orderBy("source_type")


def rollup(alerts: DataFrame) -> DataFrame:
    """F1 + F2 + F4 in one pass: GROUPING SETS ((severity), (rule_id), ())."""
    return (alerts.groupingSets([["severity"], ["rule_id"], []], "severity", "rule_id")
                  .agg(F.count(F.lit(1)).alias("n_alerts"), F.grouping_id().alias("gid")))


def totals(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """one row, total alerts and total events."""
    a = alerts.agg(F.count(F.lit(1)).alias("total_alerts"))
    e = events.agg(F.count(F.lit(1)).alias("event_count"))
    return a.crossJoin(e)  # one row x one row


def summary_dict(alerts: DataFrame, events: DataFrame) -> dict:
    """The report summary as a dict (reads only the small rollups)."""
    # one pass over the alerts for both breakdowns (GROUPING SETS), one over the events
    sets = rollup(alerts).collect()
    sev = {r["severity"]: r["n_alerts"] for r in sets if r["gid"] == 1}
    rule = {r["rule_id"]: r["n_alerts"] for r in sets if r["gid"] == 2}
    src = {r["source_type"]: r["n_events"] for r in by_source_type(events).collect()}
    import datetime as _dt
    return {
        "generated_at": _dt.datetime.now(_dt.timezone.utc).isoformat(),  # J15, kept out of compared outputs
        "total_alerts": sum(sev.values()),
        "by_severity": sev, "by_rule": rule, "by_source_type": src,
        "true_positive_estimates": dict(K.TRUE_POSITIVE_ESTIMATES),
        "false_positive_notes": list(K.FALSE_POSITIVE_NOTES),
    }


def rules_list(spark: SparkSession, rules=None) -> DataFrame:
    """Rule id, name and severity, sorted by id."""
    rules = [cls() for cls in RULES.values()] if rules is None else rules
    rows = [(r.rule_id, r.rule_name, r.severity) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, rule_name string, severity string").orderBy("rule_id")
