"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, written_at


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the smallest node it is connected with.

    Each step takes a minimum per node, which is combined before the shuffle, and a join that
    hands it to the node's edges; no neighbourhood is gathered. Every round is written to the
    shared folder.
    """
    spark = edges.sparkSession
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = written_at(pairs, "cc")
    state = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_path = written_at(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        drop_path(spark, path)
        now, path = new, new_path
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (sums["n"], sums["h"]) == state:
            break
        state = (sums["n"], sums["h"])
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
