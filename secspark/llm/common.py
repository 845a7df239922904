"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one of the driver's tables, keeping only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Stands in for a null id while rows are in Python: pandas would turn a column of longs with nulls into doubles.
NO_ID = -(1 << 63)


def key_id(column: str = "doc_id") -> Column:
    """An id as a long that is never null (null: the lowest long)."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def restored(df: DataFrame, *columns: str) -> DataFrame:
    """Null again where :func:`key_id` put its stand-in."""
    return df.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in columns})


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column's text form, modulo n."""
    return F.pmod(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")), F.lit(n))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the SplitMix64 output function)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash each run of ``width`` token hashes; a shorter, non-empty sequence is one shingle."""
    if not len(tokens):
        return tokens
    width = min(width, len(tokens))
    n = len(tokens) - width + 1
    prime = np.uint64(0x9E3779B97F4A7C15)
    h = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        h = h * prime + tokens[k:k + n]
    return mix64(h)
