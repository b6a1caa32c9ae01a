"""The corpus pipeline's stages, each on what the one before kept, against brute force on planted cases."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_shrink(spark, sf_dir, kept):
    before = table(spark, sf_dir, "documents").count()
    for docs in kept[:-1]:
        assert docs.columns == COLUMNS
        assert 0.7 * before < docs.count() <= before
        before = docs.count()


def test_packing_holds_every_document_that_is_left(kept):
    assert {r["doc_id"] for r in kept[-1].select("doc_id").collect()} == {r["doc_id"] for r in kept[-2].select("doc_id").collect()}


def test_no_exact_copies_or_leaks_remain(spark, sf_dir, kept):
    left = kept[3].toPandas()
    texts = [" ".join(t.lower().split()) for t in left["text"] if len(t.split()) > 5]
    assert len(texts) == len(set(texts))
    items = [" ".join(r["text"].lower().split()) for r in table(spark, sf_dir, "benchmark").collect()]
    assert not [i for i in items if any(f" {i} " in f" {t} " for t in texts)]


@pytest.mark.parametrize("number", range(5))
def test_a_stage_takes_empty_tables_and_edge_rows(spark, sf_dir, number):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text without id", "en", None, 3), (4, "twice " * 9, "en", "s", 5), (4, "twice " * 9, "en", "s", 5), (5, "x" * 20000, "en", "s", 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = corpus_pipeline.STAGES[number][1]
    assert stage(spark, docs.filter("false"), sf_dir).count() == 0
    got = stage(spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in got} == {1, 2, None, 4, 5} and np.isin([r["doc_id"] for r in got if r["doc_id"]], [1, 2, 4, 5]).all()


@pytest.mark.parametrize("number", range(4))
def test_a_stage_keeps_columns_of_the_names_it_uses(spark, sf_dir, number):
    rows = [(i, f"line {i}\n" + " ".join(f"w{i * j % 97}" for j in range(40)), "en", "s", 5) for i in range(1, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("_score", "_kept", "_all", "_parts", "_host", "_lines", "_salt", "rep", "node", "block", "ids", "pairs", "component")
    for n in names:
        docs = docs.withColumn(n, F.lit(7))
    got = corpus_pipeline.STAGES[number][1](spark, docs, sf_dir)
    assert got.columns == docs.columns and got.count() == len(rows)
    assert {r[n] for r in got.collect() for n in names} == {7}


def test_near_copies_and_toxic_documents_go(spark, sf_dir):
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    base, rows = words(120), []
    for k in range(12):  # one word of 120 differs from the base: a similarity of 111 / 121
        w = list(base)
        w[10 * k] = f"other{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + i, " ".join(words(80))) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf_dir).collect()}
    assert left == {0, *range(100, 130)}
    docs, labels = table(spark, sf_dir, "documents"), {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, sf_dir).select("doc_id").collect()}
    clean = [d for d, toxic in labels.items() if toxic == 0]
    assert sum(d in kept for d in clean) >= 0.9 * len(clean)  # a model of some sixty documents


def test_one_full_copy_of_a_large_group_is_left(spark, sf_dir):
    rng = np.random.default_rng(3)
    line = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 5000, n))
    clean = "\n".join(line(12) for _ in range(6))
    texts = [clean] * 40 + ["menu of the site\n" + line(40) for _ in range(80)]
    rows = [(i, t, "en", "host", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = written(stage(spark, docs, sf_dir), "copies-test")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [i for i, t in left.items() if t == clean] == [0] and set(left) == {0, *range(40, 120)}
    assert all(t == texts[i].split("\n", 1)[1] for i, t in left.items() if i)
