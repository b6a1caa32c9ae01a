"""Rule tables with terms, ledgers that add up or fail, and risks, on small cases."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from veridoc.functions.text import STOPWORDS
from veridoc.operators import assess, evaluation

ROWS = [
    ("dp", None, 1800.0, "single", [(1.0, 170.0)]), ("dp", 1800.0, 6900.0, "max", [(1.1, 0.0), (1.0, 170.0)]), ("dp", 6900.0, None, "single", [(1.1, 0.0)]),
    ("few", None, 100.0, "min", [(2.0, 0.0), (1.0, 50.0)]), ("few", 200.0, 300.0, "single", [(1.0, 0.0)]), ("few", 250.0, 400.0, "single", [(1.0, 0.0)]), ("open", None, None, "max", [(1.1, 0.0), (1.0, 170.0)]),
]
CASES = [
    ("dp", 1500.0, "kPa", 1700.0, "kPa", "COMPLIANT", 1670.0, None), ("dp", 1500.0, "kPa", 1600.0, "kPa", "NON_COMPLIANT", 1670.0, None), ("dp", 3000.0, "kPa", 3300.0, "kPa", "COMPLIANT", 3300.0, None),
    ("dp", 3000.0, "kPa", 3200.0, "kPa", "NON_COMPLIANT", 3300.0, None), ("dp", 1000.0, "kPa", 1170.0, "kPa", "COMPLIANT", 1170.0, None), ("dp", 8000.0, "kPa", 8800.0, "kPa", "COMPLIANT", 8800.0, None),
    ("dp", 1800.0, "kPa", 1970.0, "kPa", "COMPLIANT", 1970.0, None), ("dp", 30.0, "barg", 34.0, "barg", "COMPLIANT", 3300.0, None), ("dp", 30.0, "barg", 34.0, "bara", "NEEDS_ENGINEER_REVIEW", None, "not one scale"),
    ("dp", 30.0, "bara", 3.4, "MPa", "NEEDS_ENGINEER_REVIEW", None, "not one scale"), ("dp", 3.0, "MPa", 34.0, "bar", "COMPLIANT", 3300.0, None), ("dp", 3.0, "furlong", 34.0, "bar", "NEEDS_ENGINEER_REVIEW", None, "unit not read"),
    ("dp", None, "kPa", 1.0, "kPa", "NEEDS_ENGINEER_REVIEW", None, "unit not read"), ("few", 80.0, "kPa", 130.0, "kPa", "COMPLIANT", 130.0, None), ("few", 150.0, "kPa", 900.0, "kPa", "NEEDS_ENGINEER_REVIEW", None, "outside every row"),
    ("few", 260.0, "kPa", 900.0, "kPa", "NEEDS_ENGINEER_REVIEW", None, "in more than one row"), ("few", 250.0, "kPa", 250.0, "kPa", "COMPLIANT", 250.0, None), ("few", -5.0, "kPa", -10.0, "kPa", "COMPLIANT", -10.0, None),
    ("none", 5.0, "kPa", 5.0, "kPa", "NEEDS_ENGINEER_REVIEW", None, "outside every row"), ("open", 1e-15, "kPa", 170.0, "kPa", "COMPLIANT", 170.0, None), ("open", 1e15, "MPa", 2e15, "MPa", "COMPLIANT", 1.1e18, None), ("open", 0.0, "kPa", 1.0, "kPa", "NON_COMPLIANT", 170.0, None),
]


def test_rule_rows_units_scales_and_terms(spark):
    values = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(CASES)], "id long, rule_id string, input double, input_unit string, output double, output_unit string")
    rows = spark.createDataFrame(ROWS, "rule_id string, lo double, hi double, op string, terms array<struct<k:double,c:double>>")
    got = {r["id"]: (r["status"], r["required"], r["reason"]) for r in assess.evaluate_rules(values, rows).collect()}
    for i, c in enumerate(CASES):
        assert got[i][0] == c[5] and got[i][2] == c[7] and got[i][1] == (None if c[6] is None else pytest.approx(c[6])), c
    assert {r["reason"] for r in assess.evaluate_rules(values, rows.filter("false")).collect()} == {"outside every row", "not one scale", "unit not read"}


def test_a_rule_table_of_many_rows(spark):
    rows = spark.range(20_000).selectExpr("'big' AS rule_id", "id * 1.5D AS lo", "(id + 1) * 1.5D AS hi", "'single' AS op", "array(struct(1D AS k, cast(id AS double) AS c)) AS terms")
    values = spark.range(1, 1900).selectExpr("id", "'big' AS rule_id", "id * 15.1D AS input", "'kPa' AS input_unit", "1e9D AS output", "'kPa' AS output_unit")
    plan = assess.evaluate_rules(values, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan and "NestedLoop" not in assess.evaluate_rules(values, rows)._jdf.queryExecution().executedPlan().toString()
    for r in assess.evaluate_rules(values, rows).collect():
        x = r["id"] * 15.1
        k = int(-(-x // 1.5)) - 1
        assert r["required"] == pytest.approx(x + k) or abs(x / 1.5 - round(x / 1.5)) < 1e-9


STATES = ("checked", "not_checked")


@pytest.mark.parametrize("planted,said", [([], None), ([(1, "checked", "x")], "1 decided twice"), ([(9, "checked", "x")], "1 not in scope"), ([(None, "checked", "x")], "1 not in scope"), ([(3, "odd", "x")], "1 of an unknown state"), ([(3, None, "x")], "1 of an unknown state")])
def test_a_ledger_adds_up_or_fails(spark, planted, said):
    schema = "requirement_id long, state string, reason_code string"
    decided = [(1, "checked", "compared"), (2, "not_checked", "unreadable"), *([] if any(p[0] == 3 for p in planted) else [(3, "checked", "compared")]), *planted]
    counts = assess.ledger_counts(spark.createDataFrame([(1,), (2,), (3,)], "requirement_id long"), spark.createDataFrame(decided, schema), STATES)
    if said is None:
        assert sorted(map(tuple, counts.collect())) == [("checked", "compared", 2), ("not_checked", "unreadable", 1)]
    else:
        with pytest.raises(Exception, match=f"does not add up.*{said}"):
            counts.collect()


def test_a_ledger_without_decisions_fails_and_one_of_nothing_is_empty(spark):
    none, scope = spark.createDataFrame([], "requirement_id long, state string, reason_code string"), spark.createDataFrame([(1,)], "requirement_id long")
    with pytest.raises(Exception, match="1 without a decision"):
        assess.ledger_counts(scope, none, STATES).collect()
    assert assess.ledger_counts(scope.filter("false"), none, STATES).collect() == []


def test_four_kinds_of_risk_and_none_opened_twice(spark):
    day = lambda n: datetime.datetime(2024, 5, n)
    deliverables = [(1, None, day(1), False), (2, 1, day(20), False), (3, 1, day(20), True), (4, 2, day(1), True), (5, 4, day(20), False), (6, None, None, False), (7, 6, day(20), False), (8, None, day(10), False), (9, 8, None, False), (10, 99, day(11), False)]
    findings = [(100, True, day(1), False, False), (100, True, day(2), False, True), (100, True, day(9), True, False), (101, False, day(1), True, True), (102, True, None, True, True), (None, True, day(1), True, True), (103, True, day(1), False, False)]
    held = [("schedule", 1), ("review", 103), ("compliance", 101), ("dependency", 1)]
    d = spark.createDataFrame(deliverables, "id long, parent_id long, due timestamp, closed boolean")
    f = spark.createDataFrame(findings, "document_id long, open boolean, updated timestamp, deviation boolean, unresolved boolean")
    known = spark.createDataFrame(held, "risk_type string, key_id long")
    now = F.lit("2024-05-10 12:00:00").cast("timestamp")
    first = assess.risks(d, f, known, now)
    # 2 and 9 wait for open parents that are due; 4 is closed, so 5 waits for nothing
    assert sorted(map(tuple, first.collect())) == [("compliance", 102, 1), ("dependency", 2, 1), ("dependency", 9, 1), ("review", 100, 2)]
    again = assess.risks(d, f, known.unionByName(first.select("risk_type", "key_id")), now)
    assert again.count() == 0
    assert ("schedule", 1, 9) in set(map(tuple, assess.risks(d, f, known.filter("false"), now).collect()))


def brute_scores(sentences, passages):
    """The measures of one answer, sentence by sentence; passages are (n, text, gold)."""
    content = lambda t: [w for w in re.findall(r"[^\W_]+", re.sub(r"\[\d+\]", " ", (t or "").lower())) if len(w) > 1 and w not in STOPWORDS]
    figures = lambda t: set(re.findall(r"[0-9][0-9.,]*[0-9]|[0-9]", re.sub(r"\[\d+\]", " ", t or "")))
    claims = [s for s in sentences if len(content(s)) >= 3]
    share = lambda s, texts: sum(w in {x for t in texts for x in content(t)} for w in content(s)) / len(content(s))
    holds = lambda s, pool: share(s, [t for _, t, _ in pool]) >= 0.7 and figures(s) <= {f for _, t, _ in pool for f in figures(t)}
    ok = cites = cited_claims = relevant = noise = 0
    for s in claims:
        marks = {int(m) for m in re.findall(r"\[(\d+)\]", s)} & {n for n, _, _ in passages}
        pool = [p for p in passages if not marks or p[0] in marks]
        gold = [p for p in pool if p[2]]
        ok += holds(s, pool)
        cited_claims += bool(marks)
        cites += len(marks)
        relevant += sum(share(s, [t]) >= 0.4 for _, t, _ in pool) if marks else 0
        noise += (bool(marks) and not gold) or not holds(s, gold)
    n = len(claims)
    part = lambda a, b: round(a / b, 6) if b else None
    return n, part(ok, n), part(cited_claims, n), part(relevant, cites), part(noise, n)


def test_answer_scores_against_a_plain_loop(spark):
    words = ["the", "pressure", "valve", "12", "3.5", "lug", "shall", "bar", "über", "[1]", "[2]", "[7]", "a"]
    rng = random.Random(167)
    said = lambda k: " ".join(rng.choice(words) for _ in range(k))
    answers = [(i, [said(rng.randrange(0, 9)) for _ in range(rng.randrange(1, 6))]) for i in range(60)] + [(60, []), (61, ["insufficient"]), (62, [None, "valve lug bar pressure"])]
    passages = [(i, n, said(rng.randrange(0, 14)) if rng.random() < 0.95 else None, rng.random() < 0.5) for i in range(58) for n in range(1, rng.randrange(1, 5))]
    got = evaluation.answer_scores(spark.createDataFrame(answers, "a_id long, sentences array<string>"), spark.createDataFrame(passages, "a_id long, n int, text string, gold boolean")).collect()
    want = {i: brute_scores([s for s in ss if s is not None], [p[1:] for p in passages if p[0] == i]) for i, ss in answers}
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(set(want.values())) > 15
