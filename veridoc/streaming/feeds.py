"""File feeds with duplicates dropped, event windows with late data bounded, and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def table_feed(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def new_documents(feed: DataFrame, seen_for: str = "7 days") -> DataFrame:
    """Documents whose text has not come within `seen_for` by the column arrived (a timestamp)."""
    hashed = feed.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return hashed.withWatermark("arrived", seen_for).dropDuplicatesWithinWatermark(["sha256"])


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window; what comes later than `late` is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events less than `gap` apart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def write_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch to a folder of its own, so that a repeated batch replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
