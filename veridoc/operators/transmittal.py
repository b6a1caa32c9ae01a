"""Documents that transmittals list, against the ones that are held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A document's number: a word of letters first, parts behind separators; and a revision behind it on its line.
NUMBER, REVISION = "[A-Za-z]{2,8}([_/.-][A-Za-z0-9]+)+", "(?i)\\brev(ision)?[ .:]*([A-Z0-9]{1,3})\\b"


def norm(number: Column) -> Column:
    """A number as it is compared: upper case, one separator."""
    return F.upper(F.regexp_replace(F.trim(number), r"[ \t_/.-]+", "-"))


def norm_rev(rev: Column) -> Column:
    return F.regexp_replace(F.upper(rev), "[^A-Z0-9]", "")


def checked(lines: DataFrame, held: DataFrame) -> DataFrame:
    """list_id, number, revision, status and reason: each number a list holds, where it first stands, and whether it is held so.

    `lines` has list_id, own (the list's own number), pos and line; `held` has number and revision, of any spelling. A revision is
    read behind its number and before the next one. A number without digits, the list's own, and a null line list nothing; what is
    held without a number is left out. A list is never failed: what is not held as stated is a query, with the first reason.
    """
    mark = "\u0001"
    pieces = F.split(F.regexp_replace("line", f"({NUMBER})", f"{mark}$1"), mark)
    p = lines.select("list_id", norm(F.col("own")).alias("own"), "pos", F.posexplode(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))).alias("nth", "piece"))
    p = p.withColumn("number", norm(F.regexp_extract("piece", f"^{NUMBER}", 0))).withColumn("revision", norm_rev(F.regexp_extract("piece", REVISION, 2)))
    p = p.filter(F.col("number").rlike("[0-9]") & ~F.equal_null("number", F.col("own")))
    first = p.groupBy("list_id", "number").agg(F.min_by("revision", F.struct("pos", "nth", "revision")).alias("revision"))
    h = held.select(norm(F.col("number")).alias("number"), norm_rev(F.col("revision")).alias("r")).filter("number <> ''")
    # one row for each number and revision, and one for each number, so that no set of revisions is gathered
    each = h.filter("r <> ''").distinct().select("number", F.col("r").alias("revision"), F.lit(True).alias("same"))
    any_of = h.groupBy("number").agg(F.count_if(F.coalesce("r", F.lit("")) != "").alias("n_revisions"))
    j = first.join(each, ["number", "revision"], "left").join(any_of, "number", "left")
    reason = (
        F.when(F.col("n_revisions").isNull(), "not held").when(F.col("revision") == "", "no revision stated").when(F.col("n_revisions") == 0, "held without a revision")
        .when(F.col("same"), "revision held").otherwise("another revision is held")
    )
    return j.withColumn("reason", reason).select("list_id", "number", "revision", F.when(F.col("reason") == "revision held", "pass").otherwise("query").alias("status"), "reason")
