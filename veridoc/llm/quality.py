"""Quality by positive-unlabelled learning with a non-negative unbiased risk.

Documents known to be good are the trusted positives; the unlabelled ones are a sample of
the corpus as it is. A first classifier, fitted on half of both, tells positives from
unlabelled text. Its scores are counted over all documents and all positives that it has not seen; the share of positives
in the corpus, the class prior, is the least ratio of the two tails, taken where the bound on
its error is least. The final classifier minimises
    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])
under the logistic loss l, so that its sigmoid is the probability of a good document.

Features: pairs of neighbouring byte classes, hashed words, and bins of whole-text measures.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, written
from .shingles import mix, words_of_all
from .tokens import batches_of

#: Fit bounds: trusted positives and unlabelled documents that the classifiers are fitted on.
POSITIVES, UNLABELLED = 2500, 5000
#: Bins of the first classifier's scores, and how sure the bound on the prior's error is.
SCORE_BINS, DELTA = 1000, 0.1
WORD_BUCKETS, MEASURES, MEASURE_BINS = 1024, 12, 10
STEPS, RATE, RIDGE = 300, 0.03, 5e-3


def _classes() -> np.ndarray:
    """A class for every byte: lower, upper, digit, white space, line end, other control, non-ASCII, and each sign."""
    out = np.zeros(256, np.int64)
    b = np.arange(256)
    for k, where in enumerate([(b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), np.isin(b, [32, 9, 11, 12, 13]), b == 10, b >= 128]):
        out[where] = k + 1
    signs = [x for x in range(33, 127) if not chr(x).isalnum()]
    out[signs] = 7 + np.arange(len(signs))
    return out


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1
SIZE = N_CLASSES * N_CLASSES + WORD_BUCKETS


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct keys each owner has, and how often its most frequent one occurs."""
    seen, first, times = np.unique(mix(keys ^ mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner[first], times)
    return np.bincount(owner[first], minlength=n), most


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Shares of class pairs and of word buckets (square roots), and the measures, of every text; a null text counts as empty."""
    n = len(texts)
    raws = [(t or "").encode() for t in texts]
    sizes = np.fromiter(map(len, raws), np.int64, n)
    data = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
    kinds = CLASSES[data]
    owner = np.repeat(np.arange(n), sizes + 1)  # of each pair; a text is read between two line ends
    shares = np.zeros((n, SIZE), np.float32)
    pairs = N_CLASSES * N_CLASSES
    counts = np.bincount(owner * pairs + kinds[:-1] * N_CLASSES + kinds[1:], minlength=n * pairs).reshape(n, pairs)
    shares[:, :pairs] = np.sqrt(counts / (sizes[:, None] + 1))
    hashes, of, lens = words_of_all(texts)
    n_words = np.bincount(of, minlength=n)
    buckets = np.bincount(of * WORD_BUCKETS + (hashes >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS, minlength=n * WORD_BUCKETS)
    shares[:, pairs:] = np.sqrt(buckets.reshape(n, -1) / np.maximum(1, n_words)[:, None])
    distinct, most = _distinct(hashes, of, n)
    inner = of[1:] == of[:-1]
    with np.errstate(over="ignore"):
        both = mix(hashes[:-1] * np.uint64(3) + hashes[1:])[inner]
    distinct_pairs, _ = _distinct(both, of[:-1][inner], n)
    by_class = np.bincount(owner * N_CLASSES + kinds[:-1], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    size, letters = np.maximum(1, sizes), by_class[:, 1] + by_class[:, 2]
    pressed = np.array([len(zlib.compress(r, 1)) for r in raws])
    measures = np.stack([
        np.log1p(sizes), np.log1p(n_words), distinct / np.maximum(1, n_words), distinct_pairs / np.maximum(1, n_words - 1),
        most / np.maximum(1, n_words), np.bincount(of, lens, n) / np.maximum(1, n_words), (letters + by_class[:, 6]) / size,
        by_class[:, 2] / np.maximum(1, letters), by_class[:, 3] / size, by_class[:, 7:].sum(1) / size, by_class[:, 5] / size, pressed / size,
    ], 1)
    return shares, measures


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimise(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> np.ndarray:
    """Weights (the constant last) of least non-negative risk on positives `p` and unlabelled `u` under a prior; without one, of p against u.

    Steps get shorter towards the end, and the weights are the mean of the last half's, so that the turns at the bound even out.
    """
    w, m, v, total = (np.zeros(p.shape[1] + 1, np.float32) for _ in range(4))
    grad = lambda x, weight: np.append(weight @ x, weight.sum()) / len(x)
    for t in range(1, steps + 1):
        f_p, f_u = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        if prior is None:
            g = grad(p, -_sigmoid(-f_p)) + grad(u, _sigmoid(f_u))
        else:
            negative = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
            of_negative = grad(u, _sigmoid(f_u)) - prior * grad(p, _sigmoid(f_p))
            # below zero the negative part only fits noise: it is driven back up
            g = prior * grad(p, -_sigmoid(-f_p)) + of_negative if negative >= 0 else -of_negative
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - np.float32(rate * (1 - t / (steps + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if 2 * t > steps:
            total += w
    return total / (steps - steps // 2)


def tail_prior(unlabelled: np.ndarray, positives: np.ndarray, delta: float = DELTA) -> float:
    """The share of positives among the unlabelled from counts by bins of a score, the highest last: the ratio of the tails where its bound is least."""
    n_u, n_p = unlabelled.sum(), positives.sum()
    if not n_u or not n_p:
        return 0.5
    q_u, q_p = (np.cumsum(c[::-1]) / c.sum() for c in (unlabelled, positives))
    slack = math.sqrt(math.log(4 / delta) / 2 / n_u) + math.sqrt(math.log(4 / delta) / 2 / n_p)
    ok = q_p > slack
    at = np.argmin((q_u[ok] + slack) / q_p[ok]) if ok.any() else -1
    ratio = (q_u[ok] / q_p[ok])[at] if ok.any() else 0.5
    return float(np.clip(ratio, 0.01, 0.99))


@dataclass
class Model:
    """Means and scales of the features, bounds of the measures' bins, the prior and the weights; without weights every score is 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    bounds: np.ndarray
    prior: float = 0.5
    weights: np.ndarray | None = None

    def rows(self, shares: np.ndarray, measures: np.ndarray) -> np.ndarray:
        out = np.zeros((len(shares), SIZE + MEASURES * MEASURE_BINS), np.float32)
        out[:, :SIZE] = (shares - self.mean) / self.scale
        at = np.arange(len(shares))
        for k in range(MEASURES):
            out[at, SIZE + k * MEASURE_BINS + np.searchsorted(self.bounds[k], measures[:, k])] = 1
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 0.5)
        return _sigmoid(self.rows(*features(texts)) @ self.weights[:-1].astype(np.float32) + self.weights[-1]).astype(float)


def _sample(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the documents with these ids, one row of each, and which are the first classifier's."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shares, measures = features(b["text"].tolist())
            yield pd.DataFrame({"x": [r.astype(np.float16).tobytes() for r in shares], "m": [r.tobytes() for r in measures], "first": b["_first"]})

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    rows = in_batches(chosen, made, "x binary, m binary, first boolean", rows=500).collect()
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float16).reshape(len(rows), SIZE).astype(np.float32)
    return x, np.frombuffer(b"".join(r["m"] for r in rows)).reshape(len(rows), MEASURES), np.array([r["first"] for r in rows], bool)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> Model:
    """A model from the positives (quality 1) for which `held_out` (of doc_id) is not true, and from documents as they come.

    At most POSITIVES and UNLABELLED documents are fitted on, those with the least hashes of
    their doc_id; the prior is counted over all documents but those of the first classifier. Of
    labels only quality 1 is read; a doc_id with several labels is positive where one is.
    Without positives or documents every score is 0.5.
    """
    ids = docs.filter(~F.coalesce(held_out, F.lit(True))).select("doc_id").distinct()
    trusted = ids.join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id")
    order, half = F.xxhash64("doc_id"), (F.xxhash64("doc_id", F.lit(2)) % 2 == 0).alias("_first")
    chosen = [written(rows.orderBy(order).limit(most).select("doc_id", half), "quality-sample") for rows, most in ((trusted, POSITIVES), (ids, UNLABELLED))]
    (p, measures_p, first_p), (u, measures_u, first_u) = (_sample(docs, c) for c in chosen)
    if not (first_p.any() and first_u.any()):
        return Model(np.zeros(SIZE), np.ones(SIZE), np.zeros((MEASURES, MEASURE_BINS - 1)))
    bounds = np.quantile(measures_u, np.linspace(0, 1, MEASURE_BINS + 1)[1:-1], axis=0).T
    model = Model(u.mean(0), np.maximum(u.std(0), 1e-2), bounds)
    p, u = model.rows(p, measures_p), model.rows(u, measures_u)
    model.weights = minimise(p[first_p], u[first_u], None)
    seen = chosen[0].union(chosen[1]).filter("_first").select("doc_id").distinct()
    scored = score(docs.select("doc_id", "text"), model).select("doc_id", F.least((F.col("_score") * SCORE_BINS).cast("int"), F.lit(SCORE_BINS - 1)).alias("bin"))
    unseen = scored.join(F.broadcast(seen), "doc_id", "left_anti").join(trusted.select("doc_id", F.lit(1).alias("good")), "doc_id", "left")
    by_bin = np.zeros((2, SCORE_BINS), np.int64)
    for r in unseen.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("good")).collect():
        by_bin[:, r["bin"]] = r["n"], r["good"]
    model.prior = tail_prior(*by_bin)
    model.weights = minimise(p, u, model.prior)
    return model


def score(docs: DataFrame, model: Model, into: str = "_score") -> DataFrame:
    """`docs` with `into`, from 0 to 1: higher where a document is likelier a good one. A null text counts as empty.

    Every row has its score, also those without doc_id or that repeat others; a column named as `into` gives way to it.
    """
    docs = docs.drop(into)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            found = [model.scores(texts[i:j]) for i, j in batches_of(texts)]
            yield b.assign(**{into: np.concatenate(found) if found else np.zeros(0)})

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return in_batches(docs, scored, f"{names}, `{into}` double", rows=500)
