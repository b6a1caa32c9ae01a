"""Acronyms read from the texts that define them, by scope, and questions reworded with them."""

import pytest

from veridoc.operators import acronyms
from veridoc.plans import acronyms as plans

SCHEMA = "doc_id long, scope string, text string"


def known(spark, *texts, scope="a"):
    rows = [(i, scope, t) for i, t in enumerate(texts)]
    return {(r["acronym"], r["expansion"], r["n_docs"]) for r in acronyms.harvest(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("nominal dry film thickness (NDFT)", ("NDFT", "nominal dry film thickness")),
        ("It needs the nominal dry film thickness ( NDFT ).", ("NDFT", "nominal dry film thickness")),
        ("NDFT (nominal dry film thickness) is given", ("NDFT", "nominal dry film thickness")),
        ("NACE National Association of Corrosion Engineers", ("NACE", "national association of corrosion engineers")),
        ("a Post-Weld Heat Treatment (PWHT) follows", ("PWHT", "post-weld heat treatment")),
        ("PWHT Post-Weld Heat\nTreatment", ("PWHT", "post-weld heat treatment")),
        ("inspection and test plan (ITP)", ("ITP", "inspection and test plan")),
        ("plan of organic matter (POM)", ("POM", "plan of organic matter")),
        ("plan of organic matter (POOM)", ("POOM", "plan of organic matter")),
        ("long prose in front of any such definition hides no welding procedure specification (WPS)", ("WPS", "welding procedure specification")),
    ],
)
def test_each_form_defines_an_acronym(spark, text, want):
    assert known(spark, text) == {(*want, 1)}


@pytest.mark.parametrize("text", ["show that (AB)", "interpret this by the two boundary layers (BC)", "coating (C)", "one two three (ONE)", "dry film thickness (DFTX)", "dry film, thickness (DFT)",
                                  "DFT dry film thickness of the coat.", "(DFT)", "DFT", "", None, ")DFT( (", "a b c d e f g h i (ABCDEFGHI)"])
def test_what_the_initials_do_not_spell_is_none(spark, text):
    assert known(spark, text) == set()


def test_rows_follow_each_other(spark):
    text = "Abbreviations CPS coating procedure specification DFT dry film thickness NDT non-destructive testing"
    assert {a for a, _, _ in known(spark, text)} == {"CPS", "DFT", "NDT"}


def test_documents_are_counted_once_and_scopes_apart(spark):
    rows = [(1, "a", "dry film thickness (DFT) and DFT (dry film thickness)"), (1, "a", "dry film thickness (DFT)"), (2, "a", "dry film thickness (DFT)"), (3, "b", "design for test (DFT)"), (4, None, "dry film thickness (DFT)")]
    got = {tuple(r) for r in acronyms.harvest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "DFT", "dry film thickness", 2), ("b", "DFT", "design for test", 1), (None, "DFT", "dry film thickness", 1)}


def test_a_very_long_text_and_an_empty_table(spark):
    assert known(spark, "word " * 200_000 + "dry film thickness (DFT)") == {("DFT", "dry film thickness", 1)}
    assert known(spark, "A" * 100_000, "(" * 50_000) == set()
    assert acronyms.harvest(spark.createDataFrame([], SCHEMA)).collect() == []


def asked(spark, questions, texts):
    k = acronyms.harvest(spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(texts)], SCHEMA))
    q = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(questions)], "question_id long, scope string, text string")
    return {r["question_id"]: (r["spelled"], r["abbreviated"], r["n_meanings"]) for r in acronyms.reworded(q, k).collect()}


def test_questions_are_worded_both_ways_within_their_scope(spark):
    texts = [("a", "dry film thickness (DFT)"), ("a", "nominal dry film thickness (NDFT)"), ("a", "non-destructive testing (NDT)"), ("b", "design for test (DFT)"), ("b", "dry film thickness (DFT)")]
    questions = [("a", "What is the DFT?"), ("b", "What is the (DFT), then?"), ("a", "Is Nominal Dry  Film Thickness, or non destructive testing, asked?"), ("c", "What is the DFT?"), (None, "DFT"), ("a", "dft"), ("a", None), ("a", "")]
    assert asked(spark, questions, texts) == {
        0: ("What is the dry film thickness?", None, 1),
        1: ("What is the (design for test), then?", None, 2),
        2: (None, "Is NDFT, or NDT, asked?", None),
    }


def test_texts_and_questions_are_read_once(spark, sf_dir):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    harvested = plan(acronyms.harvest(plans._texts(spark, sf_dir)))
    assert "Filter isnotnull(CASE" not in harvested and "Filter exists(" not in harvested
    asked = spark.createDataFrame([(1, "a", "the DFT and dry film-thickness"), (2, "b", None), (3, None, "DFT")], "question_id long, scope string, text string")
    known = spark.createDataFrame([("a", "DFT", "dry film thickness", 1)], "scope string, acronym string, expansion string, n_docs long")
    reworded = acronyms.reworded(asked, known)
    assert [tuple(r) for r in reworded.collect()] == [(1, "the dry film thickness and dry film-thickness", "the DFT and DFT", 1)]
    assert plan(reworded).count("Generate explode") == 1
