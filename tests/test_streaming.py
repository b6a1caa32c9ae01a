"""Streams over files, run to completion."""

from pyspark.sql import functions as F

from veridoc.sources.tables import read
from veridoc.streaming import feeds


def test_windowed_counts_equal_the_batch(spark, sf_dir, tmp_path):
    batch = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    batch.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = feeds.windowed_counts(feeds.table_feed(spark, str(tmp_path / "in"), batch.schema))
    feeds.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0]
    assert 0.9 * batch.count() <= got <= batch.count()  # the last window stays open


def test_new_documents_come_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b")], "doc_id long, text string").withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = feeds.new_documents(feeds.table_feed(spark, str(tmp_path / "in"), rows.schema))
    feeds.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_sessions_schema(spark, sf_dir, tmp_path):
    batch = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    batch.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = feeds.sessions(feeds.table_feed(spark, str(tmp_path / "in"), batch.schema))
    feeds.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter("n < 1 or stop < start").count() == 0
