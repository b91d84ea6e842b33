"""Shared tables between steps: Parquet under the folder in spark.checkpoint.dir, which all executors reach."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own, which only a local master may use."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="strandex-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Written once and read again: cuts the lineage of loops, and lets several steps share one computation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandex-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame, size: int, each: int) -> int:
    """So many that none gets more than `each` of `size` on average, and all cores have some."""
    return max(-(-size // each), df.sparkSession.sparkContext.defaultParallelism)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be over
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
