"""The edition of a standard that a contract applies, by dates as coarse as they are printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR, MONTH, DAY = "^[0-9]{4}$", "^[0-9]{4}-(0[1-9]|1[0-2])$", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def first_day(issued: Column) -> Column:
    """The first day that a date of year, month or day may mean; null where it cannot be read."""
    return F.when(issued.rlike(YEAR), F.try_to_date(F.concat(issued, F.lit("-01-01")))).when(issued.rlike(MONTH), F.try_to_date(F.concat(issued, F.lit("-01")))).when(issued.rlike(DAY), F.try_to_date(issued))


def last_day(issued: Column) -> Column:
    return F.when(issued.rlike(YEAR), F.try_to_date(F.concat(issued, F.lit("-12-31")))).when(issued.rlike(MONTH), F.last_day(F.try_to_date(F.concat(issued, F.lit("-01"))))).when(issued.rlike(DAY), F.try_to_date(issued))


def applied_editions(editions: DataFrame, policies: DataFrame) -> DataFrame:
    """family, outcome and the editions that apply: one, two where another one is named and the stricter holds, else none.

    `editions` has family, edition and issued (text); `policies` has one row a family: family, cutoff (text of day or month), latest
    (the newest always applies) and named (an edition that the contract names, or null). The first that holds: an edition without a
    readable date; none on file; the newest of two that overlap where the latest applies; a date that reaches into the cutoff; none
    in time; two in time that overlap; a named edition that is not on file. A cutoff that cannot be read tells nothing. Repeated
    rows count once; editions of no policy are left out.
    """
    c = F.col("cutoff")
    e = editions.select("family", "edition", "issued").distinct()
    j = policies.select("family", "latest", "named", first_day(c).alias("from"), last_day(c).alias("to")).join(e, "family", "left")
    j = j.withColumn("first", first_day(F.col("issued"))).withColumn("last", last_day(F.col("issued")))
    in_time = F.col("last") <= F.col("from")
    j = j.withColumn("wanted", F.coalesce(F.col("last").isNotNull() & (F.col("latest") | in_time), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("family", "wanted").orderBy(F.desc_nulls_last("last"), "edition"))
    at = lambda n, x: F.max(F.when(F.col("wanted") & (F.col("rank") == n), F.col(x)))
    g = j.withColumn("rank", rank).groupBy("family").agg(
        F.bool_or("latest").alias("latest"), F.max("named").alias("named"), F.max("from").alias("from"), F.count_if(F.col("edition").isNotNull() & F.col("last").isNull()).alias("undated"), F.count("last").alias("dated"),
        F.count_if((F.col("first") <= F.col("to")) & (F.col("last") > F.col("from"))).alias("coarse"), at(1, "edition").alias("best"), at(1, "first").alias("begins"), at(2, "last").alias("next"),
        F.coalesce(F.bool_or((F.col("edition") == F.col("named")) & F.col("last").isNotNull()), F.lit(False)).alias("held"))
    overlap, other = F.coalesce(F.col("next") >= F.col("begins"), F.lit(False)), F.coalesce(F.col("named") != F.col("best"), F.lit(False))
    outcome = (
        F.when(F.col("undated") > 0, "undated edition").when(F.col("dated") == 0, "none on file").when(F.col("latest") & overlap, "newest not told")
        .when(~F.col("latest") & F.col("from").isNull(), "cutoff not read").when(~F.col("latest") & (F.col("coarse") > 0), "date too coarse").when(F.col("best").isNull(), "none in time").when(overlap, "overlapping dates")
        .when(other & ~F.col("held"), "named edition not on file").when(other, "both").otherwise("picked")
    )
    chosen = F.when(F.col("outcome") == "picked", F.array("best")).when(F.col("outcome") == "both", F.array("best", "named"))
    return g.withColumn("outcome", outcome).select("family", "outcome", F.array_join(chosen, "; ").alias("editions"))
