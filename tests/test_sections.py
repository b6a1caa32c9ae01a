"""Titles of any kind, what looks like one, and the sections they cut."""

import pytest

from pyspark.sql import functions as F
from veridoc.operators import sections
from veridoc.plans import sections as plans

PROSE = "The plant is divided into nodes, each with a clear design intent."


def lines(spark, *pages):
    return sections.title_lines(spark.createDataFrame([(1, n + 1, t) for n, t in enumerate(pages)], "doc_id long, page int, text string"))


def reasons(spark, *pages):
    return {r["title"]: r["reason"] for r in lines(spark, *pages).filter("kind is not null").collect()}


def cut(spark, *pages):
    rows = sorted(sections.refined_sections(lines(spark, *pages)).collect(), key=lambda r: r["section"])
    return [(r["heading"], r["page_start"], r["page_end"]) for r in rows]


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("ZX-77-ATT02 - CRITERIA FOR NODE SELECTION", "coded"), ("Annex B - Calibration of the method", "worded"), ("Appendix C: Data sheets", "worded"),
        ("Attachment 4 – Reporting template", "worded"), ("Table B7.2: Invented targets", "table"), ("Table 3. Pump list", "table"), ("Figure 2 - Flow of the method", "figure"),
        ("6. Independent Protection Layers", "item"), ("Table B7.2 is used to rate the invented scenario", None), ("Table 4 shows the value", None), ("ATTACHMENTS AND TEMPLATES", None),
        ("The attachment ATT02 describes the nodes in detail and is part of the study basis.", None), ("1. Reliability - a guard reduces the invented loss by at least a factor of two.", None),
        ("Table 3. " + "word " * 40, None),
    ],
)
def test_titles_by_kind(spark, line, kind):
    assert [r["kind"] for r in lines(spark, line).collect()] == [kind]


@pytest.mark.parametrize("line", ["Annex B - Scope ..... 12", "Annex B - Scope\t12", "Annex B - Scope … 3", "Annex B - Scope 14", "Annex B - Scope.. 7"])
def test_a_line_with_a_page_number_is_of_the_contents(spark, line):
    assert list(reasons(spark, line).values()) == ["contents entry"]


def test_a_numbered_item_counts_behind_an_attachment_only(spark):
    item = "6. Independent Protection Layers"
    assert reasons(spark, f"{item}\n{PROSE}") == {item: "item of a list"}
    assert reasons(spark, f"Annex B - Method\n{PROSE}\n{item}\n{PROSE}")[item] is None
    got = reasons(spark, f"Annex B - Method\nAnnex C - Rest\nAnnex D - End\n{PROSE}\n{item}")  # a list of attachments is none
    assert got[item] == "item of a list" and got["Annex B - Method"] == "contents run"


def test_runs_cross_blank_lines_pages_and_running_lines_and_end_at_text(spark):
    head, a, b, c = "Appendix A: General", "Annex B - Method", "Annex C - Rest", "Annex D - End"
    got = reasons(spark, f"{head}\n{a}\n \n{b}", f"{head}\n{c}\n{PROSE}", f"{head}\n{PROSE}")
    assert got == {head: "running", a: "contents run", b: "contents run", c: "contents run"}
    assert reasons(spark, f"{a}\n{b}\n{PROSE}\n{c}") == {a: None, b: None, c: None}


def test_a_line_on_two_pages_is_not_running_and_cuts_twice(spark):
    assert cut(spark, f"Annex B - Method\n{PROSE}", f"Annex B - Method\n{PROSE}") == [("Annex B - Method", 1, 2), ("Annex B - Method", 2, 2)]


def test_sections_with_their_pages_parents_and_texts(spark):
    pages = [f"intro\nZX-77-ATT02 - NODES\n{PROSE}", f"nodes text\nTable B3.1: List of words\nrows\n2. Worked Case\n{PROSE}", "", None, f"{PROSE}\nZX-77-ATT03 –  GUIDEWORDS\nwords"]
    t = lines(spark, *pages)
    rows = sorted(sections.refined_sections(t).collect(), key=lambda r: r["section"])
    assert [tuple(r)[1:] for r in rows] == [
        (0, None, None, None, 1, 1, 1, False),
        (1, "ZX-77-ATT02 - NODES", "coded", None, 1, 2, 3, True),
        (2, "Table B3.1: List of words", "table", "ZX-77-ATT02 - NODES", 2, 2, 2, False),
        (3, "2. Worked Case", "item", "ZX-77-ATT02 - NODES", 2, 5, 3, True),
        (4, "ZX-77-ATT03 - GUIDEWORDS", "coded", None, 5, 5, 2, True),
    ]
    texts = {r["section"]: r["text"] for r in sections.section_texts(t).collect()}
    assert texts[1] == f"ZX-77-ATT02 - NODES\n{PROSE}\nnodes text" and len(texts) == 5


def test_empty_tables_repeated_pages_and_long_lines(spark):
    assert sections.title_lines(spark.createDataFrame([], "doc_id long, page int, text string")).collect() == []
    assert lines(spark, "Table 3. " + "w" * 300_000, "\n" * 50_000).count() == 1
    same = spark.createDataFrame([(1, 1, "Annex B - Method\nx")] * 2, "doc_id long, page int, text string")
    assert sorted(r["n_lines"] for r in sections.refined_sections(sections.title_lines(same)).collect()) == [1, 3]


def test_lines_are_read_once(spark, sf_dir):
    plan = plans.dropped_titles(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "posexplode" not in plan
    rows = ["a  b", "a\tb\r", " a – b—c ", "\t \r", "a b", "a \t\r b", ""]
    got = spark.createDataFrame([(r,) for r in rows], "raw string").select(sections.flat(F.col("raw")), F.col("raw").rlike("[^ \t\r]")).collect()
    want = [" ".join(r.replace("–", "-").replace("—", "-").replace("\t", " ").replace("\r", " ").split()) for r in rows]
    assert [tuple(r) for r in got] == [(w, w != "") for w in want]
