"""Requirements against facts: findings, tiers, grouped sheets and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as num


def read_requirements(reqs: DataFrame) -> DataFrame:
    """Adds kind, way, limit_value, limit_unit, is_strict of each requirement's sentence."""
    text = F.col("text")
    limit = num.as_number(F.regexp_extract(text, r"([0-9.]*[0-9]) [A-Za-z0-9/()]+\.$", 1))
    unit = F.nullif(F.regexp_extract(text, r"[0-9] ([A-Za-z0-9/()]+)\.$", 1), F.lit(""))
    out = reqs.withColumn("kind", num.requirement_type(text)).withColumn("way", num.direction(text))
    return out.withColumn("limit_value", limit).withColumn("limit_unit", unit).withColumn("is_strict", num.strict(text))


def findings(reqs: DataFrame, facts: DataFrame) -> DataFrame:
    """One finding for each fact of a numeric limit: status (null while undecided) and the reason.

    Different dimensions never compare; a unit without a factor compares with itself only.
    """
    limits = read_requirements(reqs).filter("kind = 'numeric limit'")
    limits = limits.select("req_id", "standard", "way", "is_strict", "limit_value", "limit_unit", num.dimension(F.col("limit_unit")).alias("limit_dim"), num.normalised(F.col("limit_value"), F.col("limit_unit")).alias("limit_base"))
    # what a cell and a requirement say is read once each, before they meet
    cells = facts.select("req_id", "fact_id", "page", "unit", num.as_number(F.col("cell")).alias("value"), num.blank_marker(F.col("cell")).alias("mark"), num.dimension(F.col("unit")).alias("dim"))
    cells = cells.select("*", num.normalised(F.col("value"), F.col("unit")).alias("base"))
    same, value = F.col("unit") == F.col("limit_unit"), F.col("value")
    j = cells.join(limits, "req_id").select(
        "*", same.alias("same"), (F.col("dim") == F.col("limit_dim")).alias("alike"),
        F.when(same, value).otherwise(F.col("base")).alias("a"), F.when(same, F.col("limit_value")).otherwise(F.col("limit_base")).alias("b"))
    status = F.when(F.col("same") | F.col("alike"), num.verdict(F.col("a"), F.col("b"), F.col("way"), F.col("is_strict")))
    j = j.select("*", status.alias("status"))
    reason = (
        F.when(F.col("mark") != "value", "no value given")
        .when(value.isNull(), "value is not a number")
        .when(F.col("dim").isNull(), "unit unknown")
        .when(~F.col("same") & ~F.col("alike"), "another dimension")
        .when(F.col("status").isNull() & (F.col("a") == F.col("b")), "equal to a strict limit")
        .when(F.col("status").isNull(), "unit is not converted")
        .otherwise("compared")
    )
    return j.select("req_id", "fact_id", "standard", "page", "status", reason.alias("reason"))


def tier() -> Column:
    """A for a decided finding, B for one whose value is missing, C for what an engineer must settle."""
    return F.when(F.col("status").isNotNull(), "A").when(F.col("reason") == "no value given", "B").otherwise("C")
