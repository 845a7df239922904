"""Operator 8, sharding: weighted rendezvous hashing of stable record keys.

Every shard draws one number per key, ``-ln(u) / weight`` with ``u`` uniform in (0, 1) from
a hash of (key, shard).  The shard with the smallest draw owns the key.  A draw depends on
nothing but the key, the shard and its weight, so a new shard can only take rows into itself
and its expected share is its weight's share.

Slots (gapless row numbers inside a shard) never put a shard into one task.  Each shard is
cut into hash buckets; rows are numbered inside a bucket and a small table of bucket sizes
(at most ``shards x MAX_BUCKETS`` rows) gives each bucket its offset.

Defined results: a null key is the text ``null``; a null text has no bytes and CRC 0; an
empty table gives no rows; repeated rows each get their own slot; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from secspark.llm.common import table

SHARDS = 24
ROW_OVERHEAD = 8
ROWS_PER_BUCKET = 256
MAX_BUCKETS = 4096


def record_key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def draw(key: Column, shard: int, weight: float) -> Column:
    """The shard's draw for a key: an exponential variable of rate ``weight``."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def owner(key: Column, weights: list[float]) -> Column:
    """The shard with the smallest draw (ties: the lower shard); weight 0 never owns a row."""
    draws = [F.struct(draw(key, j, w).alias("draw"), F.lit(j).alias("shard"))
             for j, w in enumerate(weights) if w > 0]
    if not draws:
        raise ValueError("at least one shard needs a positive weight")
    return F.array_min(F.array(*draws))["shard"]


def with_slots(df: DataFrame, key: str, order: list[str], shard: str = "shard",
               rows_per_bucket: int = ROWS_PER_BUCKET, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... inside each shard."""
    shards = max(1, df.agg(F.countDistinct(shard)).first()[0])
    n_buckets = min(max_buckets, max(1, math.ceil(df.count() / shards / rows_per_bucket)))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(record_key(key)), F.lit(n_buckets)).cast("int"))
    earlier = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (df.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
                 .select(shard, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    here = W.partitionBy(shard, "_bucket").orderBy(*order)
    return (df.withColumn("_place", F.row_number().over(here) - 1)
              .join(offsets, [shard, "_bucket"])
              .withColumn("slot", (F.col("_place") + F.col("_before")).cast("long"))
              .drop("_bucket", "_place", "_before"))


def shard_records(df: DataFrame, key: str = "doc_id", text: str = "text",
                  weights: list[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Place every row on a shard by its key; ``grown_shard`` is its shard once one more is added."""
    weights = weights or [1.0] * SHARDS
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    k = record_key(key)
    placed = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        owner(k, weights).alias("shard"),
        owner(k, [*weights, grown_weight]).alias("grown_shard"))
    out = with_slots(placed, "doc_id", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents", "doc_id", "text"))
