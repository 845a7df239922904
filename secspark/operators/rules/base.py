"""Rule interface (L1-L3) and the common alert shape.

A rule is metadata plus pure ``DataFrame -> DataFrame`` functions:

* ``typed(events)``    one row per alert with the rule's context as real columns
* ``alerts(events)``   the common alert shape (``pack_alerts``)
* ``evidence(events)`` one row per (alert, event fingerprint), never collected
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import constants as K
from ...functions import scalar as X
from ...schema import EVENT_FIELDS

EVENT_TYPES = dict(EVENT_FIELDS)


def event_fingerprint(prefix: str = "") -> Column:
    """J10 over the event columns of a row (optionally ``prefix``-ed names)."""
    return X.fingerprint(EVENT_FIELDS, prefix)


def event_json(prefix: str = "") -> Column:
    """The event as JSON text, every field present, the time in ISO form."""
    fields = [X.iso_utc(F.col(prefix + n)).alias(n) if n == "timestamp" else F.col(prefix + n).alias(n)
              for n, _ in EVENT_FIELDS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def seq_col(events: DataFrame) -> Column:
    """Arrival-order tie-breaker: ``ingest_seq`` when present."""
    return F.col("ingest_seq") if "ingest_seq" in events.columns else F.lit(0)


def json_context(*cols: Column) -> Column:
    """Context as JSON text; null values are kept as ``null``."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def py_str(c: Column) -> Column:
    """Python ``str()`` inside an f-string: None prints as ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


class Rule:
    rule_id = "BASE-000"
    rule_name = "Base rule"
    default_severity = "medium"
    description = ""

    def __init__(self, severity: str | None = None) -> None:
        self.severity = severity or self.default_severity

    # -- to implement ----------------------------------------------------
    def typed(self, events: DataFrame) -> DataFrame:
        """Columns: ``severity, description, timestamp, alert_id, n_source_events, context``."""
        raise NotImplementedError

    def evidence(self, events: DataFrame) -> DataFrame:
        raise NotImplementedError

    # -- shared ----------------------------------------------------------
    def alerts(self, events: DataFrame) -> DataFrame:
        return pack_alerts(self.typed(events), self.rule_id, self.rule_name)

    def metadata(self) -> dict:
        return {"rule_id": self.rule_id, "rule_name": self.rule_name,
                "severity": self.severity, "description": self.description}


def pack_alerts(typed: DataFrame, rule_id: str, rule_name: str) -> DataFrame:
    return typed.select(
        F.lit(rule_id).alias("rule_id"), F.lit(rule_name).alias("rule_name"),
        F.col("severity"), X.severity_rank("severity").alias("severity_rank"),
        F.col("description"), F.col("timestamp"), F.col("alert_id"),
        F.col("n_source_events").cast("bigint").alias("n_source_events"),
        F.col("context"))


def alert_key(rule_id: str, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(rule_id), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])

