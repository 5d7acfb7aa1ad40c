"""Lineage cuts that survive lost executors: tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own in local mode alone."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="meshwalk-")
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, instead_of: Iterable[DataFrame] = (), codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lineage ends there.

    ``instead_of`` are earlier cuts that nothing needs once this one is written, such
    as a loop's last round; their files go. ``codec`` zstd suits tables that carry texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the write's own shuffle files go with it
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for old in instead_of:
        discard(old)
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a cut. Other frames are left alone."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
