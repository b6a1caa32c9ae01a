"""Site-relative line frequency: lines on more than a share of a host's pages are boilerplate.

DataFrame functions alone. A page counts a line once however often it stands there. Blank
lines are neither counted nor dropped. Lines are compared as 64-bit hashes within a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_to, written

RATIO, MIN_PAGES = 0.05, 5
#: Boilerplate lines up to which the table of them is broadcast (about 16 bytes each).
BROADCAST_LINES = 500_000
SALTS = 64


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False
) -> DataFrame:
    """One row per host with boilerplate: _host, and _lines, the hashes of its lines on more than `ratio` of its pages.

    A line must also be on `min_pages` pages, so that a host of a few pages keeps its text.
    A host has at most (mean lines per page / ratio) such lines, which bounds _lines. With
    `copies_once`, pages of a host with the same text (by its hash) are one page throughout.
    """
    seen = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))
    rows = pages.select(F.col(host).alias("_host"), seen.alias("_seen"), F.xxhash64(F.col(text)).alias("_text"))
    if copies_once:
        rows = rows.groupBy("_host", "_text").agg(F.first("_seen").alias("_seen"))
    totals = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    counts = (
        rows.select("_host", F.explode("_seen").alias("_line"))
        .groupBy("_host", "_line")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= min_pages)
    )
    often = counts.alias("c").join(totals.alias("t"), F.expr("c._host <=> t._host")).filter(F.col("_n") > ratio * F.col("_pages"))
    return often.groupBy("c._host").agg(F.collect_set("_line").alias("_lines"))


def drop_site_lines(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False, counts: tuple[str, str] = ("_kept", "_all")
) -> DataFrame:
    """`pages` with boilerplate lines taken out of `text`, and two `counts`: of lines kept, and of all.

    Every row stays, with all its columns but those named as `counts`, which give way to them; a
    null text stays null and an empty one empty, and has one line. Rows of a null host form one
    host. Repeated rows count each (but see `copies_once` of `boilerplate`). The hosts' line
    tables are broadcast up to BROADCAST_LINES entries; beyond, the join is by host and a salt,
    so that a large host is spread over SALTS groups.
    """
    pages = pages.drop(*counts)
    names = pages.columns
    rows = pages.toDF(*(f"c{i}" for i in range(len(names))))  # so that no column clashes with those made here
    host, text = (f"c{names.index(c)}" for c in (host, text))
    found = written(boilerplate(rows, host, text, ratio, min_pages, copies_once), "site-lines")
    size = found.agg(F.coalesce(F.sum(F.size("_lines")), F.lit(0)).alias("n")).first()["n"]
    on = F.col(host).eqNullSafe(F.col("_host"))
    if size <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(found), on, "left")
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int"))
        spread = found.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, on & (F.col("_salt") == F.col("_spread")), "left")
    parts = bound_to(
        F.struct(_lines(text).alias("all"), F.coalesce(F.col("_lines"), F.array().cast("array<bigint>")).alias("bad")),
        lambda s: F.struct(
            F.size(s["all"]).alias("all"),
            F.filter(s["all"], lambda x: (F.trim(x) == "") | ~F.array_contains(s["bad"], F.xxhash64(x))).alias("kept"),
        ),
    )
    kept = F.when(F.col(text).isNotNull(), F.array_join("_parts.kept", "\n")).alias(text)
    cols = [kept if c == text else F.col(c) for c in rows.columns]
    return joined.withColumn("_parts", parts).select(*cols, F.size("_parts.kept"), F.col("_parts.all")).toDF(*names, *counts)
