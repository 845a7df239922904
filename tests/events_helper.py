"""Sample events shared by the test modules (a plain module: every test folder has a ``conftest`` of its own)."""

import datetime as dt

from secspark.schema import EVENT_FIELDS

BASE = dt.datetime(2026, 3, 7, 14, 0, 0, tzinfo=dt.timezone.utc)


def make_events(spark, rows: list[dict]):
    """Events frame from dicts (missing fields null, labels default empty, ingest_seq = list order)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(n, t) for n, t in EVENT_FIELDS] + [T.StructField("ingest_seq", T.LongType())])
    data = []
    for i, r in enumerate(rows):
        d = {n: r.get(n) for n, _ in EVENT_FIELDS}
        d["labels"] = r.get("labels") or {}
        d["source_type"] = r.get("source_type", "test")
        d["ingest_seq"] = i
        data.append(d)
    return spark.createDataFrame(data, schema)


def at(seconds: float = 0, minutes: float = 0, hours: float = 0):
    return BASE + dt.timedelta(seconds=seconds, minutes=minutes, hours=hours)
