"""Counts of events by time window, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Number and sum of values by window and type. Of a stream, events later than `late` are dropped by the watermark."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    sums = source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return sums.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def upserted(batches: DataFrame, path: str, checkpoint: str, merge, keep: int = 2):
    """A stream whose batches go through merge(old, batch) into versions of a table at path.

    Every batch writes a version of its own, so a batch that runs again after a
    lost executor replaces the same one. The last `keep` versions stay, two at
    least: the one that readers have and the one that it came from."""
    if keep < 2:
        raise ValueError("a batch that runs again needs the version before its own")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else batch.limit(0)
        merge(old, batch).write.mode("overwrite").parquet(f"{path}/v{number}")
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - keep}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
