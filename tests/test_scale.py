"""Plans and results that larger tables depend on: what is sent whole, what meets what, and cuts that a small table hides."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridoc.functions import numbers as num
from veridoc.functions.rules import first_rule
from veridoc.operators import gate, text
from veridoc.plans import answers, figures, ledgers, registers, structure


@pytest.mark.parametrize("most", [None, 0])
def test_fields_meet_on_their_rarest_word(spark, most):
    held = ["the size of the red bolt", "red ring", "bolt", "", "the hot bolt is red"]
    texts = spark.createDataFrame([(n, sorted(set(t.split(" ")))) for n, t in enumerate(held)] + [(9, None)], "req_id long, held array<string>")
    names = ["size", "red bolt", "hot ring", "bolt", "none such", "", "red"]
    fields = spark.createDataFrame([(f, sorted(set(f.split(" ")))) for f in names] + [("null", None)], "field string, words array<string>")
    want = sorted((n, f) for n, t in enumerate(held) for f in names if set(f.split(" ")) <= set(t.split(" ")))
    assert sorted(tuple(r) for r in ledgers.fields_held(texts, fields, most).collect()) == want


def test_requirements_are_not_sent_whole(spark, sf_dir):
    plan = ledgers.containment_join(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    side = ledgers.containment_join(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "broadcast" in plan and "BuildLeft" not in side


def test_figures_round_as_the_sql_casts(spark, tmp_path):
    # 0.9 mm is 1 where a cast rounds; 0.5 goes to the even 0; line 1 of the page asks for "1|mm"
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    rows = [(39395, 1, 1, 3, 1.0), (39395, 2, 2, 3, 9.0)]
    spark.createDataFrame(rows, line).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = answers.grounded_figures(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["figures"], r["grounded"]) for r in got] == [(39395, 2, 1)]


def test_near_copies_against_brute_force(spark):
    rng = np.random.default_rng(9)
    sets = {}
    for n in (1, 2, 7, 20, 40, 150, 900):  # copies with 0 to 12 % of the words changed, of sizes on both sides of a class
        base = [f"w{n}x{i}" for i in range(n)]
        for k in range(8):
            own = [f"own{n}y{k}z{i}" for i in range(int(n * rng.uniform(0, 0.12)))]
            sets[len(sets)] = set([*base[: n - int(n * rng.uniform(0, 0.12)) or 1], *own, *(["common"] if k % 2 else [])])
    docs = spark.createDataFrame([(i, " ".join(sorted(x))) for i, x in sets.items()], "doc_id long, text string")
    first = {}
    for i, x in sets.items():
        first.setdefault(frozenset(x), i)
    ids = sorted(first.values())
    share = lambda i, j: round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6)
    want = {(i, j, share(i, j)) for i in ids for j in ids if i < j and share(i, j) >= 0.85}
    assert {tuple(r) for r in text.near_copies(docs).collect()} == want and len(want) > 50


def test_bits_never_differ_more_than_the_sets(spark):
    rng = np.random.default_rng(3)
    rows = [(sorted({int(x) for x in rng.integers(-(2**63), 2**63 - 1, int(n))}),) for n in rng.integers(1, 3000, 30)] + [([-1, 0, 63, 64, 2**63 - 1],)]
    got = spark.createDataFrame(rows, "words array<bigint>").withColumn("bits", text._parity("words")).collect()
    d = spark.createDataFrame([(r["words"], s["words"], r["bits"], s["bits"]) for r in got[:12] for s in got[-12:]], "wa array<bigint>, wb array<bigint>, a array<bigint>, b array<bigint>")
    for longs, part in ((text.COARSE, lambda c: F.slice(c, 1, text.COARSE)), (text.FINE, lambda c: F.slice(c, text.COARSE + 1, text.FINE))):
        for r in d.select("wa", "wb", text._differ(part("a"), part("b"), longs).alias("n")).collect():
            assert r["n"] <= len(set(r["wa"]) ^ set(r["wb"]))


def test_signs_but_the_first_need_a_minus_or_a_caret():
    assert [new for pattern, new in num.SIGNS[:1]] == ["-"] and all("-" in p.replace("0-9", "").replace("A-Z", "").replace("a-z", "") or "\\^" in p for p, _ in num.SIGNS[1:])


def test_a_text_is_searched_for_numbers_once(spark, sf_dir):
    plan = figures.numbers_found(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    rows = spark.createDataFrame([("−5 to –6, ⁻7 at 10⁻³ or 2 x 10⁻⁴ m², 8-9",), (None,), ("",)], "text string")
    got = [r["x"] for r in rows.select(num.number_values(F.col("text")).alias("x")).collect()]
    assert got == [[-5.0, -6.0, -7.0, 0.001, 0.0002, 2.0, 8.0, 9.0], None, []]


def test_fields_of_a_series_are_shuffled_once(spark, sf_dir):
    plan = structure.series_merge(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Expand" not in plan


def test_applicability_deals_tasks_out_by_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ledgers, "ROWS_A_TASK", 500)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    made = ledgers.applicability(spark, sf_dir)
    assert made.rdd.getNumPartitions() == -(-lines // 500) > 4
    assert sum(r["n"] for r in made.select("n").collect()) == ledgers.statements(spark, sf_dir).filter("text <> ''").count()


def test_numbers_are_read_only_where_the_row_key_can_stand(spark, sf_dir):
    texts = ["at 24.5 mm", "24.5.2", "124.5", "2⁴.5", "5-24.5", "24.5 x 10^3", "24.5x10⁻²", "3 x 10^24.5", "-24.5", "24 .5", "24,5", "", None, "10²⁴.5", "10^-24.5", "see P-24.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(num.lists(F.col("t"), "24.5").alias("a"), F.array_contains(num.number_list(F.col("t")), "24.5").alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())
    assert "translate(" in answers.hit_boosts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("array_contains")[0]


def test_roots_leave_every_rule_as_it_is(spark):
    said = ["Not Less Than", "no less than", "not below", "at least", "MINIMUM", "not fewer than", "not exceed", "no more than", "not more than", "not above", "at most", "maximum", "up to", "less than", "below", "under", "greater than", "more than", "above", "exceeding"]
    said += ["5-6 mm", "BETWEEN 4", "class 300", "Refer To", "per asme", "PER API", "see para", "a If b", "a when b", "a unless b", "Maximum 2 of the 3", "shall", "MUST", "7", "", "ash"]
    texts = spark.createDataFrame([(s,) for s in said] + [(None,)], "text string")
    for rules, roots in ((registers.COMPARED, registers.COMPARED_ROOTS), (registers.REQUIRED, registers.REQUIRED_ROOTS)):
        plain, rooted = first_rule(F.col("text"), rules, "none"), first_rule(F.col("text"), rules, "none", roots, F.lower("text"))
        rows = texts.select("text", plain, rooted).collect()
        assert all(r[1] == r[2] for r in rows) and {r[1] for r in rows} == {"none", *(name for _, name in rules)}


def test_classes_of_small_words_and_scripts(spark):
    tokens = {"pump": "w", "ab": "x", "a": "o", "bcd": "o", "été": "w", "pump,": "w", "Pump": "W", "(at)": "X", "don't": "w", "12.5": "b", "P-100A": "t", "...": "e", "a1": "o"}
    got = spark.createDataFrame([(t, c) for t, c in tokens.items()], "t string, want string").select("t", "want", gate.classes(F.col("t")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in got] == [(r["t"], r["want"]) for r in got]
    plan = gate.assessed(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "\\p{L}+" in plan and "\\p{Ll}*" in plan


def test_near_copies_of_many_shapes_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(900)]
    sets = []
    for n in (5, 6, 7, 12, 60, 61, 64, 180, 190, 450, 470, 700):
        for _ in range(3):
            base = list(rng.choice(vocabulary, n, replace=False))
            for k in range(5):
                keep = base[: n - int(rng.integers(0, 1 + n // 9))]
                sets.append(set([*keep, *(f"own{len(sets)}x{i}" for i in range(int(rng.integers(0, 1 + n // 12))))]) if k else set(base))
    docs = [(i, " ".join(sorted(x))) for i, x in enumerate(sets)] + [(1000 + i, " ".join(sorted(x, reverse=True))) for i, x in enumerate(sets[::7])] + [(5000, ""), (5001, None)]
    first = {}
    for i, x in enumerate(sets):
        first.setdefault(frozenset(x), i)
    ids = sorted(first.values())
    share = lambda i, j: math.floor(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) * 1e6 + 0.5) / 1e6
    want = {(i, j, share(i, j)) for i in ids for j in ids if i < j and share(i, j) >= 0.85}
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    for name, value in (("COMMON_WORDS", 50), ("JUDGED", 3), ("BROADCAST_IDS", 1)):  # few words in order, tasks in parts, ids that are not sent
        monkeypatch.setattr(text, name, value)
    got = [tuple(r) for r in text.near_copies(rows).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_a_pair_is_met_once_and_at_any_cut(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(1, 2**62, 120)) for _ in range(4)]
    sets = [np.unique(np.concatenate([x[: 120 - k], rng.integers(1, 2**62, k)])) for x in sets for k in range(9)]
    batch = pa.record_batch([pa.array(range(36), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "words"])
    rows = pa.Table.from_batches(text._prefixes(np.empty(0, np.int64), np.empty(0, np.int64), 0.85, [batch])).sort_by([("term", "ascending"), ("kind", "ascending")]).combine_chunks()
    want = {(i, j) for i in range(36) for j in range(i + 1, 36) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.85}
    for compared, meeting, size in ((1 << 20, 1 << 16, 10_000), (1, 1, 1), (7, 40, 13)):
        monkeypatch.setattr(text, "COMPARED", compared)
        monkeypatch.setattr(text, "MEETING", meeting)
        met = [(r["a"], r["b"]) for b in text._meetings(0.85, rows.to_batches(max_chunksize=size)) for r in b.to_pylist()]
        assert want <= set(met) and len(want) > 50 and len(met) < 4 * len(want)  # a pair shares some 60 words, and more than ten of its prefixes


def test_words_go_once_to_a_group_of_near_copies(spark, monkeypatch):
    shared = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join([*shared, f"own{i}"])) for i in range(40)], "doc_id long, text string")
    plans = []
    judged = text._pairs_judged
    monkeypatch.setattr(text, "_pairs_judged", lambda *a: plans.append(judged(*a)) or plans[-1])
    assert text.near_copies(docs).count() == 40 * 39 // 2
    rows = spark.read.parquet(*{f for f in plans[-1].inputFiles() if "/named-" in f}).collect()
    assert len(rows) == 40 * 39 // 2 and len({r["task"] for r in rows}) == 1  # one group, to which each of 40 sets goes

