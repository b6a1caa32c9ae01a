"""Scope, as-of, percentile, paging, upsert and ledger operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_scope(df: DataFrame, grants: DataFrame, key: str, unowned: bool = False) -> DataFrame:
    """Rows whose `key` is granted; an empty scope grants nothing. `unowned` lets rows without a key through."""
    kept = df.join(grants.select(key).distinct(), key, "left_semi")
    return kept.unionByName(df.filter(F.col(key).isNull())) if unowned else kept


def out_of_scope(df: DataFrame, grants: DataFrame, key: str) -> DataFrame:
    """Rows whose `key` is not granted; a null key is out too."""
    return df.join(grants.select(key).distinct(), key, "left_anti")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_top.{c}").alias(c) for c in rest])


def nearest_rank(value: str, share: float) -> Column:
    """Nearest-rank percentile of a group: the sorted value at round-half-even(share * (n - 1))."""
    ordered = F.sort_array(F.collect_list(value))
    return F.element_at(ordered, F.rint(F.lit(share) * (F.count(value) - 1)).cast("int") + 1)


def nearest_ranks(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per key, from counts of distinct values so that no group's rows are gathered.

    The counts are dealt out by ranges of key and value. A row's rank is what the earlier ranges
    of its key hold, which is a sum per range and key, and what stands before it in its own range.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    dealt = counts.repartitionByRange(key, value).withColumn("_range", F.spark_partition_id())
    sums = dealt.groupBy(key, "_range").agg(F.sum("_c").alias("_s"))
    of_key = Window.partitionBy(key)
    before = F.sum("_s").over(of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")
    ranges = sums.select(key, "_range", before.alias("_before"), F.sum("_s").over(of_key).alias("_n"))
    within = F.sum("_c").over(Window.partitionBy(key, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = dealt.withColumn("_in", within).join(ranges, [key, "_range"]).withColumn("_upto", F.col("_before") + F.col("_in"))
    out = [F.max("_n").alias("n")]
    for name, share in shares.items():
        at = F.rint(F.lit(share) * (F.col("_n") - 1)) + 1
        out.append(F.min(F.when(F.col("_upto") >= at, F.col(value))).alias(name))
    return ranked.groupBy(key).agg(*out)


def keep_last(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The `n` first rows of each key in `order`."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def page_of(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page with the total of all rows beside it."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`new` rows replace `old` ones of the same key, the others are added."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def supersede(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each key of two extractions with its state: kept (met again), superseded (gone) or added."""
    a, b = old.select(key).distinct().withColumn("_old", F.lit(True)), new.select(key).distinct().withColumn("_new", F.lit(True))
    state = F.when(F.col("_old") & F.col("_new"), "kept").when(F.col("_old"), "superseded").otherwise("added")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def bands(df: DataFrame, value: str, table: DataFrame) -> DataFrame:
    """Rows with the half-open band (lo, hi] of a small rule table; outside every band the rule is null."""
    return df.join(F.broadcast(table), (F.col(value) > F.col("lo")) & (F.col(value) <= F.col("hi")), "left")


def changes(old: DataFrame, new: DataFrame, key: str, token: str) -> DataFrame:
    """What an index must do for each key: todo (new or another token) or drop (gone); unchanged keys are absent."""
    a = old.select(key, F.col(token).alias("_a"))
    b = new.select(key, F.col(token).alias("_b"))
    joined = a.join(b, key, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return joined.select(key, F.when(F.col("_b").isNull(), "drop").otherwise("todo").alias("action"))
