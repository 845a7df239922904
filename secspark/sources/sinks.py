"""Sinks (B1, B2): alerts / findings as JSON lines plus a one-row summary, and as one JSON document.

Every part is written by Spark's own writers, so any file system Spark knows
will do.  Alerts are one JSON object per line, written by every task in
parallel; the summary is one row.

The document (:func:`write_report`, :func:`write_findings_report`) is a folder of part files whose
concatenation, in the order of their names, is one JSON text.  Its lines are sorted globally, so no task holds
the whole: an alert is a line that opens it, a line for each of its events' fingerprints, and a
line that closes it.  Whether a line needs a comma depends on the line before it, which a running last value
(:mod:`secspark.operators.sequence`) brings over from task to task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import report as R
from ..operators import sequence as S

#: Kinds of lines: the document's start, an element's start, a part of it, its end, the document's end.
START, OPEN, ITEM, CLOSE, END = range(5)
SALTS = 16


def alert_json(alerts: DataFrame) -> DataFrame:
    """``value``: the alert as JSON text, its ``context`` an object (it is JSON text already)."""
    plain = F.struct("rule_id", "rule_name", "severity", "description", X.iso_utc("timestamp").alias("timestamp"),
                     "alert_id", "n_source_events")
    head = F.to_json(plain, {"ignoreNullFields": "false"})
    return alerts.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"context":'),
                                  F.coalesce("context", F.lit("null")), F.lit("}")).alias("value"))


def write_alerts(alerts: DataFrame, events: DataFrame, out_dir: str, evidence: DataFrame | None = None,
                 mode: str = "overwrite") -> dict:
    """B1: ``out_dir/alerts`` (JSON lines), ``out_dir/evidence`` and ``out_dir/summary``."""
    alert_json(alerts).write.mode(mode).text(f"{out_dir}/alerts")
    if evidence is not None:
        evidence.write.mode(mode).json(f"{out_dir}/evidence")
    summary = R.summary_dict(alerts, events)
    summary["event_count"] = sum(summary["by_source_type"].values())
    _write_summary(alerts.sparkSession, f"{out_dir}/summary", summary, mode)
    return summary


def write_findings(findings: DataFrame, out_dir: str, mode: str = "overwrite") -> dict:
    """B2: legacy findings as JSON lines + summary."""
    from ..operators import legacy as L
    findings.write.mode(mode).json(f"{out_dir}/findings")
    summary = L.findings_summary_dict(findings)
    _write_summary(findings.sparkSession, f"{out_dir}/summary", summary, mode)
    return summary


def _write_document(rows: DataFrame, start: str, end: str, order: list[str], path: str, mode: str) -> None:
    """Lines (``_kind``, ``value`` and the ``order`` columns) between a start and an end, in order, with commas."""
    spark = rows.sparkSession
    edges = spark.createDataFrame([(START, start), (END, end)], "_kind int, value string")
    lines = rows.withColumn("_top", F.lit(1)).unionByName(
        edges.withColumn("_top", F.when(F.col("_kind") == START, 0).otherwise(2)), allowMissingColumns=True)
    by = ["_top", *order]
    placed = S.running(S.in_chunks(lines, [], by), [], by, {"_before": S.Run(F.col("_kind"), "last", own=False)})
    kind, before = F.col("_kind"), F.col("_before")
    comma = ((kind == OPEN) & (before != START)) | ((kind == ITEM) & (before == ITEM))
    text = F.concat(F.when(comma, F.lit(",")).otherwise(F.lit("")), F.col("value"))
    placed.orderBy(*by).select(text.alias("value")).write.mode(mode).text(path)


def write_report(alerts: DataFrame, events: DataFrame, path: str, evidence: DataFrame | None = None,
                 summary: dict | None = None, mode: str = "overwrite") -> dict:
    """B1: ``{"summary", "alerts" (newest first), "event_count"}`` as one JSON document in part files.

    With ``evidence`` each alert has its ``source_events``; alerts that share an id (repeated log lines of a frame without
    arrival order) share them under the first.
    """
    summary = dict(summary or R.summary_dict(alerts, events))
    count = summary.pop("event_count", None)
    count = sum(summary["by_source_type"].values()) if count is None else count
    key = {"_t": -F.unix_micros("timestamp"), "_r": R.rule_order_col(), "_a": F.col("alert_id")}
    a = alerts.withColumns(key).withColumn("_tie", F.monotonically_increasing_id())
    head = F.to_json(F.struct("rule_id", "rule_name", "severity", "description", X.iso_utc("timestamp").alias("timestamp"),
                              "alert_id"), {"ignoreNullFields": "false"})
    open_ = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(', "source_events": ['))
    close = F.concat(F.lit('], "context": '), F.coalesce("context", F.lit("null")), F.lit("}"))

    def line(kind: int, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("_kind"), value.alias("value"))

    rows = a.select(*key, "_tie", F.inline(F.array(line(OPEN, open_), line(CLOSE, close)))).withColumn("_item", F.lit(""))
    if evidence is not None:
        # An alert can have any number of events: salted, so that they meet it in several tasks.
        owner = (a.groupBy("rule_id", "alert_id").agg(F.min(F.struct("_t", "_r", "_a", "_tie")).alias("_at"))
                  .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        e = evidence.withColumn("_salt", F.pmod(F.xxhash64("event_fingerprint"), F.lit(SALTS)).cast("int"))
        rows = rows.unionByName(e.join(owner, ["rule_id", "alert_id", "_salt"]).select(
            "_at.*", F.lit(ITEM).alias("_kind"), F.concat(F.lit('"'), "event_fingerprint", F.lit('"')).alias("value"),
            F.col("event_fingerprint").alias("_item")))
    _write_document(rows, f'{{"summary": {json.dumps(summary, default=str)}, "alerts": [', f'], "event_count": {count}}}',
                    [*key, "_tie", "_kind", "_item"], path, mode)
    return summary | {"event_count": count}


def write_findings_report(findings: DataFrame, path: str, mode: str = "overwrite") -> dict:
    """B2: ``{"summary", "findings"}`` as one JSON document in part files, in order of time."""
    from ..operators import legacy as L
    summary = L.findings_summary_dict(findings)
    record = F.to_json(F.struct(
        "rule_id", "severity", "title", "description", "confidence", "n_evidence",
        F.transform("evidence", lambda x: F.try_parse_json(x)).alias("evidence"), "first_seen", "last_seen"), {"ignoreNullFields": "false"})
    rows = findings.select(F.lit(OPEN).alias("_kind"), record.alias("value"), F.col("first_seen").alias("_t"), F.col("rule_id").alias("_r"),
                           F.monotonically_increasing_id().alias("_tie"))
    _write_document(rows, f'{{"summary": {json.dumps(summary)}, "findings": [', "]}", ["_t", "_r", "_tie"], path, mode)
    return summary


def _write_summary(spark: SparkSession, path: str, summary: dict, mode: str) -> None:
    spark.createDataFrame([(json.dumps(summary, default=str),)], "value string").write.mode(mode).text(path)
