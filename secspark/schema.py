"""Fixed schemas of the event, alert and legacy models."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L = T.StringType(), T.IntegerType(), T.LongType()

# Normalised event (one row per log record).
EVENT_FIELDS = [
    ("timestamp", T.TimestampType()),
    ("source_type", S),
    ("raw", S),
    ("user_name", S),
    ("user_id", S),
    ("source_ip", S),
    ("source_port", I),
    ("source_geo_country", S),
    ("destination_ip", S),
    ("destination_port", I),
    ("destination_host", S),
    ("event_action", S),
    ("event_outcome", S),
    ("event_reason", S),
    ("process_name", S),
    ("process_command_line", S),
    ("process_parent_name", S),
    ("process_pid", I),
    ("http_method", S),
    ("http_url", S),
    ("http_status_code", I),
    ("http_user_agent", S),
    ("auth_method", S),
    ("labels", T.MapType(S, S)),
]
EVENT_COLUMNS = [n for n, _ in EVENT_FIELDS]
EVENT_SCHEMA = T.StructType([T.StructField(n, t, n != "timestamp") for n, t in EVENT_FIELDS])

# Helper columns carried next to the event fields.
#   ingest_seq  BIGINT  stable arrival order, tie-breaker for equal timestamps
#   source_file STRING  file the record came from
HELPER_FIELDS = [("ingest_seq", L), ("source_file", S)]

# Common alert shape produced by ``pack_alerts``.
ALERT_SCHEMA = T.StructType([
    T.StructField("rule_id", S),
    T.StructField("rule_name", S),
    T.StructField("severity", S),
    T.StructField("severity_rank", I),
    T.StructField("description", S),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("alert_id", S),
    T.StructField("n_source_events", L),
    T.StructField("context", S),
])

# Normalised evidence: one row per (alert, event fingerprint).
EVIDENCE_SCHEMA = T.StructType([
    T.StructField("rule_id", S),
    T.StructField("alert_id", S),
    T.StructField("event_fingerprint", S),
])

# Legacy event and finding shapes.
LEGACY_EVENT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("event_type", S),
    T.StructField("source", S),
    T.StructField("host", S),
    T.StructField("user", S),
    T.StructField("ip", S),
    T.StructField("raw_message", S),
    T.StructField("metadata", S),
])
FINDING_SCHEMA = T.StructType([
    T.StructField("rule_id", S),
    T.StructField("severity", S),
    T.StructField("title", S),
    T.StructField("description", S),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("evidence", T.ArrayType(S)),
    T.StructField("first_seen", S),
    T.StructField("last_seen", S),
])
