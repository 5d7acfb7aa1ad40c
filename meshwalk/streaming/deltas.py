"""A stream of edge changes kept as a table of live edges.

The source has (src, dst, op, ts) with op ``add`` or ``remove``; the latest change of
an edge decides. Late changes beyond the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "src long, dst long, op string, ts timestamp"


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def latest(changes: DataFrame) -> DataFrame:
    """One row an edge: its latest change, removals winning ties."""
    by = Window.partitionBy("src", "dst").orderBy(F.desc("ts"), F.desc("op"))
    return changes.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def degrees_by_window(changes: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, src, n): added edges in tumbling windows, with a watermark."""
    return changes.withWatermark("ts", late).where("op = 'add'").groupBy(F.window("ts", width), "src").agg(F.count("*").alias("n"))


def keep_live(changes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch into Parquet versions ``table/v=N``; readers take the highest complete one.

    A batch writes a new version from the last one, so a batch that is run again
    writes the same version again.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.select("src", "dst", "op", "ts")
        if epoch > 0:
            new = new.unionByName(spark.read.schema(SCHEMA).parquet(f"{table}/v={epoch - 1}"))
        latest(new).write.mode("overwrite").parquet(f"{table}/v={epoch}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(spark: SparkSession, table: str, version: int) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{table}/v={version}").where("op = 'add'").select("src", "dst")
