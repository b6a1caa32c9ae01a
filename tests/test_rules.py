"""Column rules on small cases, and the SQL of the same rules on the same cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from veridoc.functions import numbers as num
from veridoc.functions import rules
from veridoc.functions import text as fx
from veridoc.operators import relational as rel
from veridoc.operators import retrieval as ret
from veridoc.plans import answers, figures, structure
from veridoc.sources import tables

NUMBERS = [
    ("-5", [-5.0]), ("−5", [-5.0]), ("+5", [5.0]), ("8,300", [8300.0]), ("9,0", [9.0]), (".5", [0.5]), ("10^-6", [1e-6]), ("10⁻⁶", [1e-6]), ("1.5 x 10^-3", [1.5e-3]), ("1e-6", [1e-6]), ("1.5×10^3", [1500.0]),
    ("5.3.2", []), ("1,2,3", []), ("range 29-343 °C", [29.0, 343.0]), ("grade T-29", [29.0]), ("ISO 8501-1", [8501.0, 1.0]), ("tolerance +/-0.5 mm", [0.5]), ("(-5)", [-5.0]), ("min –29 °C", [-29.0]), ("5 –10 mm", [5.0, 10.0]), ("", []), ("none", []), (None, None),
]


def column(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", expr.alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def test_numbers_of_a_text_in_both_engines(spark):
    texts, want = zip(*NUMBERS)
    got = column(spark, texts, num.number_values(F.col("text")))
    con = duckdb.connect()
    for t, g, w in zip(texts, got, want):
        sql = con.execute(f"SELECT {num.number_values_sql('text')} FROM (SELECT ?::VARCHAR AS text)", [t]).fetchone()[0]
        assert (g is None and w is None) or (len(g) == len(w) and all(math.isclose(a, b) for a, b in zip(g, w))), t
        assert sql == g or w is None, t


@pytest.mark.parametrize("value,text,stated", [(5, "the limit is -5 degC", False), (5, "gap 2.5 mm", False), (5, "gap 25 mm", False), (5, "gap 5 mm", True), (-5, "limit −5", True), (8300, "8,300 kPa", True), (23, "row 23.55", False), (5, "", False)])
def test_a_value_is_stated_as_a_whole_signed_number(spark, value, text, stated):
    assert column(spark, [text], num.states(F.col("text"), F.lit(float(value)))) == [stated]


def test_one_number_only(spark):
    texts = ["2.5", "8,300", "10^-6", "10⁻⁶", "5 10", "2.5 mm", "5.3.2", "abc", ""]
    assert column(spark, texts, num.one_number(F.col("text"))) == [2.5, 8300.0, 1e-6, 1e-6, None, None, None, None, None]


def test_headings(spark):
    texts = ["5.1 Introduction", "2.2.3 Location Tracking", "9.3.2 Protecting Personal Data 475", "3 L/min", "Just some ordinary text.", "330 Hudson Street, NY", "0 K(s, t) f(t) dt", "WAVE EQUATION", "7.4 Vibration Limits"]
    assert column(spark, texts, F.col("text").rlike(structure.HEADING)) == [True, True, False, False, False, False, False, False, True]


def test_sentences_keep_abbreviations(spark):
    texts = ["See para. 7.1 for it. Then stop.", "P-No. 1 materials. e.g. the lug.", "One", ""]
    got = column(spark, texts, F.split(rules.rewrite(F.col("text"), figures.MASKED), "\n"))
    assert got[0] == ["See para. 7.1 for it.", "Then stop."] and got[2:] == [["One"], [""]]
    assert got[1][-1] == "e.g. the lug."


def test_own_limits_and_claims(spark):
    texts = ["Not less than the set pressure of 5 barg.", "Not less than the greater of 5 barg.", "It is 5 barg."]
    assert column(spark, texts, F.col("text").rlike(figures.OWN_LIMIT)) == [True, True, False]
    reference = F.regexp_extract("text", figures.OWN_LIMIT, 2)  # a choice is no reference
    assert column(spark, texts, reference.rlike(figures.CHOICE)) == [False, True, False]


def test_glossary_is_blocked_before_some_words(spark):
    texts = ["is salt allowed", "salt spray test", "how humid to paint", "rusty"]
    assert column(spark, texts, rules.rewrite(F.col("text"), answers.GLOSSARY)) == ["is chlorides allowed", "salt spray test", "how relative humidity to coating", "corrosion"]


def test_first_rule_takes_the_first(spark):
    table = [("^a", "starts"), ("b", "holds")]
    assert column(spark, ["ab", "cb", "c", None], rules.first_rule(F.col("text"), table, "none")) == ["starts", "holds", "none", "none"]


def test_normalise_keeps_what_it_does_not_know(spark):
    assert column(spark, ["m² 10⁻⁶ ﬁ\u0000x\u0007y", "plain", None], fx.normalise(F.col("text"))) == ["m2 10^-6 fix y", "plain", None]


@pytest.mark.parametrize("rows", [[], [("a", None)], [("a", 1.0)], [("a", float(i % 7)) for i in range(100)] + [("b", 5.0)] * 3 + [(None, 2.0)]])
def test_nearest_ranks(spark, rows):
    got = {r["k"]: (r["n"], r["p50"], r["p95"]) for r in rel.nearest_ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        vs = sorted(v for x, v in rows if x == k and v is not None)
        at = lambda s: vs[round(s * (len(vs) - 1))]
        want[k] = (len(vs), at(0.5), at(0.95))
    got.pop(None, None), want.pop(None, None)
    assert got == want


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_suggestions_against_brute_force(spark):
    known = [("hydroprocessing", 3), ("galvanizing", 5), ("galvanising", 2), ("coating", 9), ("boating", 9), ("über", 1), ("pump", 4), ("p101", 8), ("the", 90)]
    asked = ["hydroprocesing", "galvanizng", "coatng", "boatting", "uber", "pum", "pumq", "p102", "zzzzzz", "coating", "galvnisng"]
    got = {r["word"]: (r["suggestion"], r["edits"]) for r in ret.suggestions(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(known, "term string, df long")).collect()}
    want = {}
    for w in asked:
        if len(w) < 4 or not w.isalpha() or w in dict(known):
            continue
        near = [(edits_between(w, t), -df, t) for t, df in known if len(t) >= 4 and t.isalpha() and edits_between(w, t) <= 2]
        if near:
            want[w] = (min(near)[2], min(near)[0])
    assert got == want and len(want) >= 6


def test_export_writes_what_it_was_given(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    tables.export(df, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_fragments_of_a_quote_have_to_stand_in_order(spark):
    page = "the lug shall be welded and the plate shall be welded and tested"
    cases = [(["the lug", "welded", "tested"], len(page) + 1), (["the lug", "tested", "welded"], 0), (["welded", "welded"], page.rindex("welded") + 7), (["welded", "welded", "welded"], 0), (["the lug", "absent", "tested"], 0), ([], 1), (["plate", "the lug"], 0)]
    df = spark.createDataFrame([(c, page) for c, _ in cases], "fs array<string>, page string").select(fx.in_order(F.col("fs"), F.col("page")).alias("n"))
    assert [r["n"] for r in df.collect()] == [n for _, n in cases]
