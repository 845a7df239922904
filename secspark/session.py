"""Session helpers: the settings every job here relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the engine needs for correct results (UTC timestamps, try_* parsing)
# and the scale knobs it expects (AQE coalescing and skew handling).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # JSON objects with a repeated key keep the last value, as Python's json does.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "secspark") -> SparkSession:
    """Build (or reuse) a session; used by tests, bench and examples.

    On a cluster the caller's own session is used as is; only the UTC time
    zone is forced, because every parse job reads wall-clock text as UTC.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.ui.enabled", "false")
          .config("spark.driver.memory", os.environ.get("SECSPARK_DRIVER_MEMORY", "8g"))
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        spark.conf.set(k, REQUIRED_CONF[k])
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets it to a shared file system.  Only a local-mode session
    (tests, a laptop) without the setting gets a private temporary folder;
    anywhere else a missing setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster "
                             "(checkpoints must survive the loss of an executor)")
        d = tempfile.mkdtemp(prefix="secspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the session settings results depend on to a caller's session."""
    for k in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        spark.conf.set(k, REQUIRED_CONF[k])
    return spark


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` and survives lost executors, but keeps the data
    columnar: later readers still prune columns, push filters down and skip partitions.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
