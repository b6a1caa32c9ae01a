"""Periodic runs against brute force over every start and period."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.llm import periodic_runs as pr

RNG = np.random.default_rng(12)


def brute(words, least_words=6, least_periods=4):
    """Every maximal stretch of a period, tried start by start and period by period; its smallest period alone counts."""
    n, found = len(words), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            first = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - first
            if length >= max(least_words, least_periods * q):
                found.setdefault((first, length), q)  # a multiple of it has the same bounds
    return sorted((s, n, q) for (s, n), q in found.items())


def cases():
    yield []
    for n in (1, 3, 5, 6, 7, 24, 25):
        yield [7] * n
    for k in (1, 2, 3):
        for n in (8, 30, 90):
            yield RNG.integers(0, k, n).tolist()
    for _ in range(120):
        parts = []
        for _ in range(RNG.integers(1, 6)):
            root = RNG.integers(0, RNG.integers(1, 9), RNG.integers(1, 9)).tolist()
            parts += root * RNG.integers(1, 9) + root[: RNG.integers(0, len(root) + 1)]
        yield parts


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (5, 3)])
def test_runs_against_brute_force(least):
    for words in cases():
        got = pr.runs_of([w + 1 for w in words], *least)
        assert list(map(tuple, got.tolist())) == brute(words, *least), words


def test_suffix_tree_orders_suffixes_and_gives_what_they_share():
    for words in cases():
        symbols = [w + 1 for w in words]
        tree, n = pr.SuffixTree(symbols), len(words)
        assert tree.rank.tolist() == np.argsort(sorted(range(n + 1), key=lambda i: symbols[i:])).tolist()
        if n < 2:
            continue
        i, j = RNG.integers(0, n + 1, 50), RNG.integers(0, n + 1, 50)
        i, j = i[i != j], j[i != j]
        for a, b, k in zip(i.tolist(), j.tolist(), tree.common(i, j).tolist()):
            x, y = symbols[a:], symbols[b:]
            assert k == next((m for m, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_stretches_of_many_documents_hold_every_run():
    documents = [[str(w).encode() for w in words] for words in cases()]
    assert [list(map(tuple, r.tolist())) for r in pr.runs_in_all(documents)] == [brute(d) for d in documents]
    rng = np.random.default_rng(3)
    long = [rng.integers(0, 5000, 3000).astype(str).tolist() for _ in range(4)]
    long[1][700:1900] = (long[1][700:990] * 5)[:1200]
    long[2][2000:3000] = (long[2][2000:2250] * 4)[:1000]
    documents = [[w.encode() for w in d] for d in long]
    assert [list(map(tuple, r.tolist())) for r in pr.runs_in_all(documents)] == [brute(d) for d in documents]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(kept)


def test_op12_against_brute_force(spark):
    vocab = np.array(["the", "of", "Ünd", "a", "b c", " ", "漢字"])
    texts = [None, "", " \n\t ", "one", "x " * 5, "x " * 6, " a b\na b\x0ba b\ta b ", "A a " * 7, "é\x1cf " * 9]
    texts += [" ".join(vocab[RNG.integers(0, RNG.integers(1, 8), RNG.integers(1, 120))]) for _ in range(150)]
    rows = [*enumerate(texts), (None, "y y y y y y y z"), (8, "a a a a a a a"), (8, "a a a a a a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x")).repartition(3)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    query = lambda d: pr.digests(pr.find_runs(d, pr.with_planted_period(F.col("doc_id"), F.col("text"))))
    got = query(docs).collect()
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got))) == sorted(map(repr, (expected(*r) for r in rows)))
    assert query(docs.filter("false")).count() == 0


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(30_000)]
    words[5000:25_000] = words[5000:7000] * 10
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "same " * 50_000), (3, "x" * 1_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pr.find_runs(docs).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(5000, 20_000, 2000)] and len(got[1]["collapsed"].split()) == 12_000
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 50_000, 1)] and got[2]["collapsed"] == "same"
    assert got[3]["runs"] == [] and got[3]["collapsed"] == "x" * 1_000_000
