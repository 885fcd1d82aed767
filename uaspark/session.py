"""Spark session and lineage helpers.

The library never creates a session behind the caller's back: every public
operator takes DataFrames.  ``get_session`` is for tests, the bench and the
examples.  ``ensure_checkpoint_dir`` reads ``spark.checkpoint.dir`` from the
session (a shared folder on a cluster) and only falls back to a scratch folder
when the master is local, as in tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "uaspark", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("UASPARK_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on an Arrow batch for Python ends at about ``size`` of rows, unless the
    session has a bound of its own.

    By default it ends at 10,000 rows, so long texts make batches of any size, and each
    task holds one several times: in the vector, in the buffer of the worker's pipe and
    in the worker.  A lazy result is computed after its operator has returned, so the
    setting stays with the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it from the session conf.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder (HDFS, S3,
    ...).  Only a local master may fall back to a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; on a cluster it must name a shared folder")
        configured = tempfile.mkdtemp(prefix="uaspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df``, computed once; hinted for broadcast when it has at most ``max_rows``.

    For tables with one row per group: their size follows the data, so it is
    counted before the hint is given; larger ones are joined by shuffle."""
    table = cut_lineage(df)
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table
