"""Session helpers for tests, benchmarks and scripts.

Library functions never build a session; they use the one behind their DataFrames.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "cyclelake") -> SparkSession:
    """A single-JVM session with the settings the engine expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CYCLELAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's `spark.checkpoint.dir`.

    In local mode, where driver and executors share one disk, a temporary folder stands in for a
    missing setting and goes when the process ends. Anywhere else a missing setting is an error: rows
    written to each executor's own disk would be missed without notice.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="cyclelake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows (of equal keys together) dealt over several tasks a core, for work that is heavy for its bytes.

    A file of one row group is read by one task, and adaptive execution joins small shuffle partitions; a stated number
    of partitions stays."""
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def stored(df: DataFrame) -> DataFrame:
    """Write a result that is used several times as a table in the shared folder and read it back.

    The reader prunes columns and knows sizes, later plans stay short, and the loss of an
    executor never repeats the work.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
