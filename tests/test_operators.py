"""Operators on small frames: nulls, ties, empty tables, and the invariants that hold at any size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veridoc.functions import numbers as num
from veridoc.functions import text as fx
from veridoc.operators import relational as rel
from veridoc.operators import retrieval as ret
from veridoc.operators import review, text
from veridoc.sources import pages, tables


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("token,value", [("8,300", 8300.0), ("9.0", 9.0), (".5", 0.5), ("-12", -12.0), ("5.3.2", None), ("", None), (None, None), ("1e", None)])
def test_as_number(spark, token, value):
    assert one(spark, token, num.as_number) == value


@pytest.mark.parametrize("text_,way", [("shall be not less than 5 mm", ">="), ("shall be less than 5", "<="), ("at least 3, at most 9", None), ("shall be blue", None), ("shall not exceed 4", "<=")])
def test_direction(spark, text_, way):
    assert one(spark, text_, num.direction) == way


def test_unconverted_units_are_null_not_zero(spark):
    rows = spark.createDataFrame([(5.0, "degF"), (5.0, "mm"), (5.0, "parsec"), (None, "mm")], "v double, u string")
    got = [r["n"] for r in rows.select(num.normalised(F.col("v"), F.col("u")).alias("n")).collect()]
    assert got == [None, 5000.0, None, None]


def test_equal_to_a_strict_limit_is_undecided(spark):
    rows = spark.createDataFrame([(5.0, 5.0, "<=", True), (5.0, 5.0, "<=", False), (6.0, 5.0, "<=", True), (None, 5.0, ">=", False), (6.0, 5.0, None, False)], "a double, b double, w string, s boolean")
    got = [r["v"] for r in rows.select(num.verdict(F.col("a"), F.col("b"), F.col("w"), F.col("s")).alias("v")).collect()]
    assert got == [None, "meets", "does not meet", None, None]


@pytest.mark.parametrize("cell,state", [(None, "blank"), ("  ", "blank"), ("N/A", "value"), ("later", "placeholder"), ("***", "placeholder"), ("note 3", "placeholder"), ("12", "value")])
def test_blank_marker(spark, cell, state):
    assert one(spark, cell, num.blank_marker) == state


@pytest.mark.parametrize("word,folded", [("valves", "valve"), ("bodies", "body"), ("glass", "glass"), ("boxes", "box"), ("gas", "gas"), ("tested", "tested"), ("api5ls", "api5ls")])
def test_fold_word(spark, word, folded):
    assert one(spark, word, fx.fold_word) == folded


def test_normalise(spark):
    assert one(spark, "10⁻⁶ m³ ﬁt\u0000\u0007x", fx.normalise) == "10^-6 m3 fit x"


@pytest.mark.parametrize("flags,run", [([True, True, False, True], 2), ([], 0), ([False], 0), ([None, True], 1)])
def test_longest_run(spark, flags, run):
    assert one(spark, flags, fx.longest_run, "array<boolean>") == run


def test_nearest_ranks_match_gathered_percentile(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (5, 1, 1, 9, 3)] + [("b", 2.0), ("b", None)], "k string, v double")
    got = {r["k"]: (r["n"], r["p50"], r["p95"]) for r in rel.nearest_ranks(rows, "k", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    want = {r["k"]: (r["p50"], r["p95"]) for r in rows.groupBy("k").agg(rel.nearest_rank("v", 0.5).alias("p50"), rel.nearest_rank("v", 0.95).alias("p95")).collect()}
    assert {k: v[1:] for k, v in got.items()} == want and got["a"][0] == 5 and got["b"][0] == 1


def test_scope(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    some, none = spark.createDataFrame([(1,), (1,)], "k long"), spark.createDataFrame([], "k long")
    assert [r["k"] for r in rel.in_scope(rows, some, "k").collect()] == [1]
    assert rel.in_scope(rows, none, "k").count() == 0
    assert {r["k"] for r in rel.in_scope(rows, some, "k", unowned=True).collect()} == {1, None}
    assert {r["k"] for r in rel.out_of_scope(rows, some, "k").collect()} == {2, None}


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, t string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k long, t string")
    assert {(r["k"], r["t"]) for r in rel.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, None), (4, "d")}
    assert {(r["k"], r["action"]) for r in rel.changes(old.filter("t is not null"), new.filter("t is not null"), "k", "t").collect()} == {(1, "drop"), (2, "todo"), (4, "todo")}


def test_rrf_is_symmetric_and_one_sided_ranks_count(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    ab = {r["id"]: r["fused"] for r in ret.rrf([(a, "x"), (b, "y")]).collect()}
    ba = {r["id"]: r["fused"] for r in ret.rrf([(b, "y"), (a, "x")]).collect()}
    assert ab == ba and ab[2] == max(ab.values()) and set(ab) == {1, 2, 3}


def test_bm25_on_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, "red valve"), (2, None), (3, ""), (4, "blue pipe"), (5, "old pump")], "doc_id long, text string")
    assert [r["doc_id"] for r in ret.bm25(docs, ["valve"], 5).collect()] == [1]
    assert ret.bm25(docs.filter("false"), ["valve"], 5).count() == 0


def test_quality_states_sum_to_the_documents(spark):
    docs = spark.createDataFrame([(1, "the valve opens when the pressure rises too far"), (2, ""), (3, "a : 1\nb : 2"), (4, "xx 12 zz")], "doc_id long, text string")
    got = {r["doc_id"]: (r["kind"], r["ok"]) for r in text.quality(docs).collect()}
    assert got == {1: ("prose", True), 2: ("empty", False), 3: ("table", True), 4: ("prose", False)}


def test_token_windows_cover_the_text(spark):
    words = [f"w{i}" for i in range(1000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short one"), (3, None), (4, "")], "doc_id long, text string")
    rows = text.token_windows(docs, 300, 240).orderBy("doc_id", "ordinal").collect()
    assert [r["n_tokens"] for r in rows] == [300, 300, 300, 280, 2]
    assert set(" ".join(r["chunk"] for r in rows if r["doc_id"] == 1).split()) == set(words)


def test_near_copies(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    docs = spark.createDataFrame([(1, base), (2, base + " upsilon"), (3, base), (4, "something else entirely"), (5, None)], "doc_id long, text string")
    assert [(r["a"], r["b"]) for r in text.near_copies(docs).collect()] == [(1, 2)]


def test_findings_compare_only_what_can_be_compared(spark):
    reqs = spark.createDataFrame([(1, "S", "The size shall be at least 5 mm."), (2, "S", "The temperature shall be less than 9 degF."), (3, "S", "The body shall be red.")], "req_id long, standard string, text string")
    facts = spark.createDataFrame(
        [(1, 1, 1, "1", "cm"), (1, 2, 1, "4", "mm"), (1, 3, 1, "", "mm"), (1, 4, 1, "7", "bar"), (1, 5, 1, "7", "kg"), (2, 6, 2, "9", "degF"), (3, 7, 2, "1", "mm")],
        "req_id long, fact_id long, page int, cell string, unit string",
    )
    got = {r["fact_id"]: (r["status"], r["reason"]) for r in review.findings(reqs, facts).collect()}
    assert got == {
        1: ("meets", "compared"), 2: ("does not meet", "compared"), 3: (None, "no value given"), 4: (None, "another dimension"),
        5: (None, "unit unknown"), 6: (None, "equal to a strict limit"),
    }


def test_html_text_and_masks(spark):
    html = "<html><script>var a='<b>';</script><style>p{}</style><!-- x --><p>One &amp; <b>two</b></p></html>"
    assert one(spark, html, pages.html_text) == "One & two"
    shown = tables.masked(spark.createDataFrame([("Ann", 3)], "user_name string, name_count int")).first()
    assert (shown["user_name"], shown["name_count"]) == ("An***", 3)


def test_uploads_once_per_content(spark, tmp_path):
    for name, body in (("a.txt", b"same"), ("b.txt", b"same"), ("c.txt", b"other")):
        (tmp_path / name).write_bytes(body)
    assert pages.uploads(spark, str(tmp_path)).count() == 2


def test_running_lines_are_taken_out_by_group(spark):
    rows = [(n, "a", f"Head\nown {n}\n 12 \nHead\nFoot {n % 2}") for n in range(4)] + [(4, "b", "Head\nx"), (5, None, "Head"), (6, "a", None), (7, "a", ""), (8, "a", "Head"), (9, "a", "7")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: (r["stripped"], r["text"]) for r in text.without_running_lines(docs, "source").collect()}
    assert got == {n: (3, f"own {n}\nFoot {n % 2}") for n in range(4)} | {4: (0, "Head\nx"), 5: (0, "Head"), 6: (None, None), 7: (0, ""), 8: (1, ""), 9: (1, "")}
    assert text.without_running_lines(docs.limit(0), "source").collect() == []


@pytest.mark.parametrize("block", [1, 2, 100])
def test_nearest_in_blocks_equals_brute_force(spark, block):
    vectors = [(n, [float(n % 5), float(n % 3), 1.0]) for n in range(20)]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    q = v.filter("vec_id < 4").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("asked"))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(i, j, r + 1) for i, a in vectors[:4] for r, (j, _) in enumerate(sorted((x for x in vectors if x[0] != i), key=lambda x: (-score(a, x[1]), x[0]))[:6])}
    assert {tuple(r) for r in ret.nearest(v, q, 6, itself=False, block=block).collect()} == want
    assert ret.nearest(v, q.limit(0), 6).collect() == [] and ret.nearest(v.limit(0), q, 6, block=block).collect() == []


@pytest.mark.parametrize("digits", [None, 9])
def test_nearest_keeps_ties_null_and_odd_vectors_and_makes_no_row_a_pair(spark, digits, monkeypatch):
    monkeypatch.setattr(ret, "VECTOR_BLOCK", 16)
    rng = random.Random(5)
    some = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(60)]
    vectors = dict(enumerate(some + [some[3]] * 30 + [[0.0, 0.0, float(i % 2), 0.0] for i in range(30)] + [None, [1.0, None, 0.0, 0.0], [1.0], [], [float("nan"), 0.0, 0.0, 1.0]]))
    v = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 7 = 3").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("asked"))
    pairs = v.join(q, F.col("vec_id") != F.col("q_id"))
    score = ret.dot(F.col("asked"), F.col("embedding"))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id"))
    want = pairs.select("q_id", "vec_id", (score if digits is None else F.round(score, digits)).alias("score")).withColumn("rank", rank).filter("rank <= 12")
    got = ret.nearest(v, q, 12, itself=False, digits=digits)
    assert {tuple(r) for r in got.collect()} == {(r["q_id"], r["vec_id"], r["rank"]) for r in want.collect()}
    # the crossed rows are blocks, not pairs of vectors
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan
