"""Text of HTML pages, and page files as a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def html_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; runs of white space become one space."""
    x = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files below `path` with size and sha256, one row per distinct content, the earliest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    hashed = files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))
    first = F.min(F.struct("modificationTime", "path", "length")).alias("f")
    return hashed.groupBy("sha256").agg(first).select("sha256", "f.path", "f.length", "f.modificationTime")
