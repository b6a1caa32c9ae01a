"""Positive-unlabelled quality: the risk, the prior and held-out documents."""

import numpy as np
from pyspark.sql import functions as F

from veridoc.llm import quality, queries
from veridoc.llm.common import table

RNG = np.random.default_rng(11)


def risk(w, p, u, prior):
    loss = lambda z: np.logaddexp(0, -z).mean()
    f_p, f_u = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    return prior * loss(f_p) + max(0.0, loss(-f_u) - prior * loss(-f_p))


def test_minimise_finds_the_least_risk():
    good = RNG.random(3000) < 0.7
    u = (RNG.normal(size=(3000, 3)) + np.where(good, 1.0, -1.0)[:, None] * [1, 0.5, 0]).astype(np.float32)
    p = (RNG.normal(size=(1500, 3)) + [1, 0.5, 0]).astype(np.float32)
    w = quality.minimise(p, u, 0.7, steps=600, ridge=0)
    best = risk(w, p, u, 0.7)
    for _ in range(300):  # no other weights near or far do better by more than the last steps' width
        assert risk(w + RNG.normal(size=4) * RNG.choice([0.01, 0.1, 1]), p, u, 0.7) > best - 1e-3
    f = u @ w[:-1] + w[-1]
    assert ((f > 0) == good).mean() > 0.82


def test_prior_of_a_known_mixture():
    for prior in (0.2, 0.5, 0.9):
        good = RNG.random(40_000) < prior
        scores = np.clip(RNG.normal(np.where(good, 0.7, 0.3), 0.1), 0, 0.999)
        positives = np.clip(RNG.normal(0.7, 0.1, 10_000), 0, 0.999)
        counts = [np.bincount((s * 1000).astype(int), minlength=1000) for s in (scores, positives)]
        assert abs(quality.tail_prior(*counts) - prior) < 0.03
    assert quality.tail_prior(np.zeros(1000, int), np.zeros(1000, int)) == 0.5


def test_features_are_each_texts_own():
    texts = [None, "", "Ärger über 12 Dinge!\n\nline", "same same same", "x", "word " * 20_000, "\n"]
    shares, measures = quality.features(texts)
    for k, t in enumerate(texts):
        alone = quality.features([t])
        assert np.allclose(alone[0][0], shares[k]) and np.allclose(alone[1][0], measures[k])
    assert np.isfinite(shares).all() and np.isfinite(measures).all()


def test_op11_held_out_accuracy_and_edges(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    labels = table(spark, big, "labels").select("doc_id", "quality")
    rows = queries.op11_pu_quality(spark, big).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([g["score"] > b["score"] for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == 1 for r in good]) > 0.95 and np.mean([r["predicted"] == 0 for r in bad]) > 0.5
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_fit_reads_positives_only_and_every_row_has_its_score(spark):
    prose = lambda: " ".join(RNG.choice(["tide", "harbour", "lamp", "rope", "sail"], 30))
    junk = lambda: " ".join(RNG.choice(["%%%", "$$$!!", "X9X9", "##"], 30))
    rows = [(i, prose() if i % 4 else junk()) for i in range(400)] + [(None, "no id"), (400, None), (401, ""), (401, "again"), (402, "tide " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_score", F.lit("x")).withColumn("first", F.lit(1)).repartition(3)
    positives = [(i, 1) for i in range(0, 300) if i % 4]
    labels = spark.createDataFrame(positives + [(1, 0), (None, 1), (5000, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(False))
    assert 0.5 < model.prior <= 0.99
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows)
    later = {r["doc_id"]: r["_score"] for r in got if r["doc_id"] is not None and 300 <= r["doc_id"] < 400}
    assert min(s for i, s in later.items() if i % 4) > max(s for i, s in later.items() if not i % 4)
    other = quality.fit(docs, labels.filter("quality = 1"), F.lit(False))
    assert np.array_equal(model.weights, other.weights)  # labels 0 change nothing
    none = quality.fit(docs, labels.filter("false"), F.lit(False))
    assert {r["_score"] for r in quality.score(docs, none).collect()} == {0.5}
    empty = docs.filter("false")
    assert quality.score(empty, quality.fit(empty, labels, F.lit(False))).count() == 0
