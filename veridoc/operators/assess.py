"""Rule tables with terms, ledgers that have to add up, and risks found in registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pressure units, their factor to kPa, and the scale that they name.
PRESSURES = (("kPa", 1.0, None), ("MPa", 1000.0, None), ("bar", 100.0, None), ("barg", 100.0, "gauge"), ("bara", 100.0, "absolute"), ("psig", 6.894757, "gauge"), ("psia", 6.894757, "absolute"))
#: Parts of an octave, and octaves to either side of 1, into which the bounds of a rule's rows fall.
STEPS, OCTAVES = 4, 40


def _case(unit: Column, at: int) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for row in PRESSURES:
        out = out.when(unit == row[0], F.lit(row[at]))
    return out


def _bucket(x: Column) -> Column:
    """A whole number that never falls as `x` rises: parts of octaves for positive numbers, 0 for all others."""
    part = F.floor(F.log2(x) * STEPS) + STEPS * OCTAVES + 1
    return F.when(x > 0, F.greatest(F.lit(1), F.least(part, F.lit(2 * STEPS * OCTAVES)))).otherwise(0).cast("int")


def evaluate_rules(values: DataFrame, rows: DataFrame) -> DataFrame:
    """id, status, required and reason of every stated value against its rule's table.

    `values`: id (unique), rule_id, input, input_unit, output, output_unit. `rows`: rule_id, lo,
    hi (null: without bound), op (single, max, min), terms (k, c: k times the input plus c),
    bounds and c in kPa; an input x is in a row if lo < x <= hi. The output has to reach the
    row's term, or the greatest or least of its terms. A unit that is not known, an absolute
    pressure beside one that is not, an input outside every row and one in several rows are
    for an engineer. Bare units are read as gauge.

    Values and rows meet on rule and bucket, a row once for every bucket that it covers (at most
    2 * STEPS * OCTAVES + 1), so that neither side has to be small.
    """
    norm = lambda c: F.col(c) * _case(F.col(f"{c}_unit"), 1)
    scale = lambda c: F.coalesce(_case(F.col(f"{c}_unit"), 2), F.lit("gauge"))
    v = values.select("id", "rule_id", norm("input").alias("x"), norm("output").alias("y"), (scale("input") == scale("output")).alias("one_scale"))
    v = v.withColumn("bucket", _bucket(F.col("x")))
    low, high = F.coalesce(_bucket_or_null("lo"), F.lit(0)), F.coalesce(_bucket_or_null("hi"), F.lit(2 * STEPS * OCTAVES))
    r = rows.withColumn("bucket", F.explode(F.sequence(low, F.greatest(low, high)))).withColumnRenamed("rule_id", "of")
    inside = (F.col("lo").isNull() | (F.col("lo") < F.col("x"))) & (F.col("hi").isNull() | (F.col("x") <= F.col("hi")))
    met = v.alias("v").join(r.alias("r"), (F.col("rule_id") == F.col("of")) & (F.col("v.bucket") == F.col("r.bucket")) & inside, "left")
    one = met.groupBy("id").agg(*(F.first(c).alias(c) for c in ("x", "y", "one_scale")), F.count("op").alias("n"), F.first("op", True).alias("op"), F.first("terms", True).alias("terms"))
    terms = F.transform("terms", lambda t: F.round(t["k"] * F.col("x") + t["c"], 6))
    required = F.when(F.col("op") == "min", F.array_min(terms)).otherwise(F.array_max(terms))
    reason = (
        F.when(F.col("x").isNull() | F.col("y").isNull(), "unit not read")
        .when(~F.col("one_scale"), "not one scale")
        .when(F.col("n") == 0, "outside every row")
        .when(F.col("n") > 1, "in more than one row")
    )
    status = F.when(reason.isNotNull(), "NEEDS_ENGINEER_REVIEW").when(F.round("y", 6) >= required, "COMPLIANT").otherwise("NON_COMPLIANT")
    return one.select("id", status.alias("status"), F.when(reason.isNull(), required).alias("required"), reason.alias("reason"))


def _bucket_or_null(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), _bucket(F.col(name)))


def ledger_counts(in_scope: DataFrame, decisions: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """state, reason_code and n of the `decisions` (requirement_id, state, reason_code) on `in_scope` (requirement_id).

    A requirement in scope without a decision, one decided twice or listed twice, a decision on
    something else and a state that is not known fail the job that reads the counts: a ledger
    that does not add up has none.
    """
    listed = in_scope.groupBy("requirement_id").agg(F.count(F.lit(1)).alias("listed"))
    known = F.coalesce(F.col("state").isin(*states), F.lit(False))
    decided = decisions.groupBy("requirement_id").agg(F.count(F.lit(1)).alias("decided"), F.count_if(~known).alias("unknown"))
    both = listed.join(decided, listed["requirement_id"].eqNullSafe(decided["requirement_id"]), "full_outer")
    faults = {
        "without a decision": F.col("decided").isNull(), "not in scope": F.col("listed").isNull(), "decided twice": F.col("decided") > 1,
        "listed twice": F.col("listed") > 1, "of an unknown state": F.col("unknown") > 0,
    }
    sums = both.agg(*(F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in faults.items()))
    said = F.concat_ws(", ", *(F.concat(F.col(f"`{name}`").cast("string"), F.lit(f" {name}")) for name in faults))
    wrong = sum((F.col(f"`{name}`") for name in faults), F.lit(0)) > 0
    verdict = sums.filter(F.when(wrong, F.raise_error(F.concat(F.lit("scope ledger does not add up: "), said)).cast("boolean")).otherwise(F.lit(False)))
    # the verdict has no row where all is well, and is asked for whether or not anything was decided
    counts = decisions.groupBy("state", "reason_code").agg(F.count(F.lit(1)).alias("n"))
    none = [F.lit(None).cast(t).alias(c) for c, t in counts.dtypes]
    return counts.unionByName(verdict.select(*none))


def risks(deliverables: DataFrame, findings: DataFrame, held: DataFrame, now: Column) -> DataFrame:
    """risk_type, key_id and n of the risks to open: none that `held` (risk_type, key_id) has open already.

    schedule: a deliverable (id, parent_id, due, closed) that is open and due before today, n its
    days overdue. dependency: an open one whose parent is open and due today or before, n 1.
    review: a document with findings (document_id, open, updated, deviation, unresolved) that
    stay open for over seven days; compliance: one with deviations whose evidence is unresolved;
    n counts the findings, and there is one risk a document. What has no due date, parent or
    document gives none.
    """
    d = deliverables.select("id", "parent_id", "due", "closed")
    late = F.date_diff(F.to_date(now), F.to_date("due"))
    schedule = d.filter(~F.col("closed") & (late > 0)).select(F.lit("schedule").alias("risk_type"), F.col("id").alias("key_id"), late.cast("long").alias("n"))
    parents = d.filter(~F.col("closed") & (late >= 0)).select(F.col("id").alias("parent_id")).distinct()
    dependency = d.filter(~F.col("closed")).join(parents, "parent_id", "left_semi").select(F.lit("dependency").alias("risk_type"), F.col("id").alias("key_id"), F.lit(1).cast("long").alias("n"))
    stays = F.col("open") & (F.col("updated") < now - F.expr("interval 7 days"))
    g = findings.filter("document_id is not null").groupBy("document_id").agg(F.count_if(stays).alias("review"), F.count_if(F.col("deviation") & F.col("unresolved")).alias("compliance"))
    both = g.select(F.col("document_id").alias("key_id"), F.inline(F.array(*(F.struct(F.lit(k).alias("risk_type"), F.col(k).alias("n")) for k in ("review", "compliance"))))).filter("n > 0")
    found = schedule.unionByName(dependency).unionByName(both)
    return found.join(held.select("risk_type", "key_id").distinct(), ["risk_type", "key_id"], "left_anti").select("risk_type", "key_id", "n")
