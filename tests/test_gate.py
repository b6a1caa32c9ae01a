"""The quality gate: what each text is kept for, and what is left out."""

import pytest

from veridoc.operators import gate

CASES = [
    ("", "empty"), (None, "empty"), (" \n\t ", "empty"), ("Criminal and civil penalties", "prose"), ("ab cd1 ... )( x9", "no clause"),
    ("The given vectors are solutions of a system", "prose"), ("with a surface profile of 50 to 75 micrometres for all the parts of it here", "prose"),
    ("هذا النص مكتوب باللغة العربية وليس مدعوما", "unsupported script"),
    ("| a1 | b2 |\n| c3 | d4 |", "rows of data"), ("| - | - |\n| - | - |", "no clause"), ("Color : red\nRatio : 4", "rows of data"),
    ("Table 4\n1.0\n2.5\n3.5", "named columns"), ("Depth\n10\n20\n30", "named columns"), ("11\n12\n13\n14\n15\n16\n17\n18", "dense columns"),
    ("0.00 30.0000 30.0000 30.0000 30.0000 31.0", "row of numbers"), ("1 2 3 4 5", "no clause"), ("1. 2. 3. 4. 5. 6.", "no clause"),
    ("Approved Color/s : Yellow (RAL 1023)", "data"), (": 4:1 by Volume", "data"), ("Nuts heavy 4:1", "data"), ("Nuts shall A194", "data"), ("Bolt 12 mm", "data"), ("Bolt Nut 12", "no clause"), ("12 mm", "no clause"),
    ("P-101A P-101B E-201", "tags"), ("P-101A, P-101B; (E-201) •", "tags"), ("P-101A P-101B", "no clause"),
    ("2 Set pressure 3 Set point 4 Dry film 5 Cold ring 6 Gear", "no clause"), (". . . . . . .", "no clause"),
]


def test_each_text_by_the_first_rule_that_holds(spark):
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r["doc_id"]: r["kind"] for r in gate.assessed(docs).collect()}
    assert [(t, got[n]) for n, (t, _) in enumerate(CASES)] == CASES


@pytest.mark.parametrize(
    ("text", "want"),
    [("a fine profile of 50 to 75 micrometres", 5), ("the shaft 4140 for all", 4), ("the shaft 41 40 for all", 2), ("2 Set pressure 3 Set point", 2), ("well-known don't stop", 3), ("eabeb2terfcb dn ea1s", 0), ("", 0), ("(Bolts), and “nuts”.", 3)],
)
def test_longest_clause(spark, text, want):
    got = spark.createDataFrame([(text,)], "text string").select(gate.longest_clause(gate.classes(gate.F.col("text")))).first()[0]
    assert got == want


def test_long_texts_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x1 " * 200_000 + "the end of it is one clause here"), (2, "z" * 500_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["kind"] for r in gate.assessed(docs).collect()} == {1: "prose", 2: "no clause"}
    assert gate.assessed(docs.limit(0)).collect() == []
