"""Bottom-k sketches of word-shingle hashes, by DataFrame functions alone.

A sketch is the sorted array of the `k` smallest 64-bit hashes of a text's distinct word
shingles. Sketches merge by union, and give resemblance, containment and distinct counts.
A text with fewer words than a shingle takes has its whole word sequence as its one shingle;
a text without words (or a null one) has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_to, words_of, written

K, WORDS = 64, 5
#: Block starts (two longs each) up to which they are broadcast to the scan that copies their rows.
BROADCAST_STARTS = 500_000


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Distinct 64-bit hashes of the runs of `words` words."""
    return bound_to(
        words_of(text),
        lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - (words - 1))),
                    lambda i: F.xxhash64(F.slice(ws, i, words)),
                )
            )
        ),
    )


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return F.slice(F.sort_array(shingle_hashes(text, words)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what `a` and `b` were made of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, exact where the union has at most `k` shingles; 1 for two empty sketches."""
    both = F.struct(a.alias("a"), b.alias("b"))
    return bound_to(
        both,
        lambda p: bound_to(
            merge(p["a"], p["b"], k),
            lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
                F.size(F.array_intersect(F.array_intersect(u, p["a"]), p["b"])) / F.size(u)
            ),
        ),
    )


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below `k`."""
    return bound_to(
        s,
        lambda x: F.when(F.size(x) < k, F.size(x).cast("double")).otherwise(
            F.lit(float(k - 1)) * F.lit(2.0**64) / (F.element_at(x, k).cast("double") + F.lit(2.0**63) + 1)
        ),
    )


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of `a`'s shingles that `b` has too; null where `a` has none."""
    count = distinct_count(merge(a, b, k), k) * resemblance(a, b, k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), count / distinct_count(a, k)))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, key: str, carry: list[str], block: int = 1024) -> DataFrame:
    """Adds next_<c> for each of `carry`: its value in the row with the next `key`; the last row's next is the first.

    Keys are dealt to blocks of `block` consecutive values, and a block also gets a copy of
    the first row of the block after it, so no window spans more than a block's rows. Block
    starts are chained in the same way, by groups of `block` blocks.
    """
    at = F.expr(f"(`{key}` - pmod(`{key}`, {block})) div {block}")
    dealt = docs.filter(F.col(key).isNotNull()).withColumn("_block", at)
    blocks = dealt.groupBy("_block").agg(F.min(key).alias("_first"))
    group = F.expr(f"(_block - pmod(_block, {block})) div {block}")
    blocks = blocks.withColumn("_group", group)
    groups = blocks.groupBy("_group").agg(F.max("_block").alias("_end"))
    ends = groups.select(
        "_group",
        F.coalesce(
            F.lag("_end").over(Window.orderBy("_group")),
            F.max("_end").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("_before"),
    )
    before = F.lag("_block").over(Window.partitionBy("_group").orderBy("_block"))
    starts = (
        blocks.withColumn("_prior", before)
        .join(ends, "_group")
        .select(F.col("_first").alias(key), F.coalesce("_prior", "_before").alias("_block"))
    )
    starts = written(starts, "block-starts")
    if starts.count() <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    copies = docs.join(starts, key).withColumn("_copy", F.lit(True))
    rows = dealt.withColumn("_copy", F.lit(False)).unionByName(copies)
    order = Window.partitionBy("_block").orderBy("_copy", key)
    out = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carry))
    return out.filter(~F.col("_copy")).drop("_block", "_copy")


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Sketches of each document, of its edited text and of the next document, with their likeness.

    The edited text has the last quarter of the code points (rounded down) replaced by as many
    from the start of the next document by doc_id; the last document's next is the first. A
    null text counts as empty; rows without doc_id are left out. Two rows of one doc_id stand
    next to each other. Other columns are not carried.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("sk", sketch(F.col("text"), k, words))
    rows = with_next(base, "doc_id", ["text", "sk"])
    n = F.char_length("text")
    edited = F.concat(F.expr("left(text, char_length(text) - char_length(text) div 4)"), F.expr("left(next_text, cast(char_length(text) div 4 as int))"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sk", "next_sk", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sk", "next_sk", F.sha2(F.col("edited"), 256).alias("edited_sha256"), sketch(F.col("edited"), k, words).alias("esk"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sk")).alias("fingerprint"),
        as_text(F.col("esk")).alias("edited_fingerprint"),
        resemblance(F.col("sk"), F.col("esk"), k).alias("near_edited"),
        resemblance(F.col("sk"), F.col("next_sk"), k).alias("near_next"),
        distinct_count(F.col("sk"), k).alias("n_shingles_est"),
        containment(F.col("sk"), F.col("esk"), k).alias("contained_in_edited"),
    )
