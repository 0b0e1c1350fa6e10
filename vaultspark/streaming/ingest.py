"""Continuous ingest: new snapshots of sources as a stream, each batch through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vaultspark.functions import md

SCHEMA = "path string, content string, mtime timestamp"


def ingest_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Follow a folder of Parquet files (path, content, mtime) and append what is new to a table of raw pages.

    A page is new if its path and hash weren't met before; state is kept for a day of event time beyond the watermark.
    """
    rows = spark.readStream.schema(SCHEMA).parquet(folder)
    hashed = rows.filter("path is not null and content is not null").select("path", "content", "mtime", F.sha2("content", 256).alias("raw_hash"), md.title(F.col("content"), md.stem(F.col("path"))).alias("title"))
    fresh = hashed.withWatermark("mtime", "1 day").dropDuplicatesWithinWatermark(["path", "raw_hash"])
    out = fresh.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()


def activity(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, operation, n of an event stream or table (ts, event_type), events later than the watermark being dropped from a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", every), F.col("event_type").alias("operation")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "operation", "n")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each path as a snapshot: every batch is merged with the snapshot before and written as the next version.

    A version is written whole before it is named, so a batch that runs again after a failure gives the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("path", "content", "mtime")
        if number:
            new = new.unionByName(spark.read.schema(SCHEMA).parquet(f"{path}/v{number - 1}"))
        new.groupBy("path").agg(F.max_by(F.struct("content", "mtime"), "mtime").alias("r")).select("path", "r.*").write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
