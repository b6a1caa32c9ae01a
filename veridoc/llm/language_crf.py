"""Language of words and documents by a linear-chain conditional random field.

Features of a word are itself (its lexicon entry), prefixes, suffixes and character n-grams,
hashed to BUCKETS rows of weights; transitions between languages are learned with them.
A run of letters too long for a word of such languages is a chain of pieces, each with its label.
Forward-backward gives each word's language within its text; a document's language is that
with the largest mean share over its words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches

BUCKETS = 1 << 17
#: Fit bounds: about so many documents a language, and so many words of them a language.
SAMPLE_DOCS, SAMPLE_WORDS = 300, 30_000
#: Words of a training sequence, and of a stretch in one language within it.
SEQUENCE, STRETCH = 48, 16
STEPS, RATE, DECAY = 40, 0.08, 1e-6
CACHED_WORDS = 600_000
#: Letters of the longest run that is one word, and of a piece of a longer one; letters that a piece repeats of the one before.
LONGEST, PIECE, SHARED = 40, 24, 2
#: Stands where a piece's run goes on.
ON = "+"
_LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Buckets of the features of a word or piece, which has prefixes and suffixes only where its run has an end."""
    w = word.encode("utf-8")
    marked = b"^" + w + b"$"
    if ON in word:
        marked = marked.replace(b"^+", b"").replace(b"+$", b"")
        parts = [b"w" + w.strip(b"+"), *(b"p" + w[:k] for k in (2, 3, 4) if w[:1] != b"+"), *(b"s" + w[-k:] for k in (2, 3, 4) if w[-1:] != b"+")]
    else:
        parts = [b"w" + w, *(b"p" + w[:k] for k in (2, 3, 4)), *(b"s" + w[-k:] for k in (2, 3, 4))]
    parts += [marked[i : i + k] for k in (2, 3) for i in range(len(marked) - k + 1)]
    crc = zlib.crc32
    return [crc(p) & (BUCKETS - 1) for p in parts]


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def pieces_of(words: list[str]) -> list[str]:
    """`words` with those of more than LONGEST letters as consecutive pieces of PIECE, marked by ON where the run goes on."""
    if not words or max(map(len, words)) <= LONGEST:
        return words
    out = []
    for w in words:
        if len(w) <= LONGEST:
            out.append(w)
            continue
        for at in range(0, len(w), PIECE):
            out.append((ON if at else "") + w[max(0, at - SHARED) : at + PIECE] + (ON if at + PIECE < len(w) else ""))
    return out


class Emissions:
    """Scores of words under each label, computed once a word."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.known = weights, {}
        self.table = np.zeros((1024, weights.shape[1]), np.float32)

    def rows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """A row number for each word of all texts in turn, and the table of scores by row."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = list(set().union(*texts).difference(self.known))
        n = len(self.known)
        while n + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for at in range(0, len(new), 20_000):
            part = [features(w) for w in new[at : at + 20_000]]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            flat = np.fromiter((f for fs in part for f in fs), np.int64, int(sizes.sum()))
            self.table[n + at : n + at + len(part)] = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)
        self.known.update(zip(new, range(n, n + len(new))))
        get = self.known.__getitem__
        total = sum(map(len, texts))
        return np.fromiter((i for t in texts for i in map(get, t)), np.int64, total), self.table


def forward_backward(emissions: np.ndarray, lens: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals of every word of sequences laid end to end, and the expected transitions.

    All sequences advance together: at step t those longer than t, which, sorted by length,
    are the first ones.
    """
    order = np.argsort(-lens, kind="stable")
    sizes = lens[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
    offsets = np.concatenate([[0], np.cumsum(alive)])
    rank = np.empty(len(lens), np.int64)
    rank[order] = np.arange(len(lens))
    t = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    place = offsets[t] + np.repeat(rank, lens)
    e = np.empty((len(place), emissions.shape[1]))
    e[place] = np.exp(emissions - emissions.max(1, keepdims=True)) if len(emissions) else 0
    a, alpha = np.exp(transitions), np.empty_like(e)
    for s in range(longest):
        here = e[offsets[s] : offsets[s + 1]]
        x = here * (np.exp(start) if s == 0 else alpha[offsets[s - 1] : offsets[s - 1] + alive[s]] @ a)
        alpha[offsets[s] : offsets[s + 1]] = x / x.sum(1, keepdims=True)
    gamma, expected = np.empty_like(e), np.zeros_like(a)
    beta = np.ones((0, e.shape[1]))
    for s in range(longest - 1, -1, -1):
        k, now = alive[s], alpha[offsets[s] : offsets[s + 1]]
        full = np.ones((k, e.shape[1]))
        if len(beta):
            ahead = beta * e[offsets[s + 1] : offsets[s + 2]]
            full[: len(beta)] = ahead @ a.T
            full /= full.sum(1, keepdims=True)
            both = now[: len(beta)]
            z = np.einsum("ni,ij,nj->n", both, a, ahead)
            expected += np.einsum("ni,nj->ij", both / z[:, None], ahead) * a
        beta = full
        g = now * beta
        gamma[offsets[s] : offsets[s + 1]] = g / g.sum(1, keepdims=True)
    return gamma[place], expected


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray


def _sequences(by_label: dict[int, list[list[str]]], seed: int = 7) -> tuple[list[list[str]], list[np.ndarray]]:
    """Training texts: half of one language throughout, half switching between languages at stretches."""
    rng, pieces = np.random.default_rng(seed), []
    for k in sorted(by_label):
        words = [w for t in by_label[k] for w in t][:SAMPLE_WORDS]
        pieces += [(k, words[i : i + STRETCH]) for i in range(0, len(words), STRETCH)]
    each, mixed = SEQUENCE // STRETCH, [pieces[i] for i in rng.permutation(len(pieces))]
    texts, labels = [], []
    for source in (pieces, mixed):
        for i in range(0, len(source), each):
            part = source[i : i + each]
            texts.append([w for _, ws in part for w in ws])
            labels.append(np.concatenate([np.full(len(ws), k) for k, ws in part]))
    return texts, labels


def train(labels: list[str], by_label: dict[int, list[list[str]]]) -> Model:
    """Maximises the conditional likelihood of the sequences, by Adam over all of them."""
    texts, truth = _sequences(by_label)
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    part = [features(w) for w in vocab]
    sizes = np.fromiter(map(len, part), np.int64, len(part))
    flat = np.fromiter((f for fs in part for f in fs), np.int64, int(sizes.sum()))
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(part)), sizes)
    at = np.fromiter((vocab[w] for t in texts for w in t), np.int64)
    lens, y, k = np.fromiter(map(len, texts), np.int64), np.concatenate(truth), len(labels)
    first = np.cumsum(lens) - lens
    inside = np.ones(len(y), bool)
    inside[first] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:-1][inside[1:]], y[1:][inside[1:]]), 1)
    hot = np.eye(k)[y]
    params = [np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)]
    m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, STEPS + 1):
        scores = np.add.reduceat(params[0][flat], starts, axis=0)[at]
        gamma, expected = forward_backward(scores, lens, params[1], params[2])
        miss = hot - gamma
        by_word = np.stack([np.bincount(at, miss[:, j], len(vocab)) for j in range(k)], 1)
        grad = np.stack([np.bincount(flat, by_word[owner, j], BUCKETS) for j in range(k)], 1)
        for i, g in enumerate((grad / len(y), (seen - expected) / len(y), miss[first].sum(0) / len(y))):
            g = g - DECAY * params[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] += RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)
    return Model(labels, params[0].astype(np.float32), params[1], params[2])


def fit(docs: DataFrame, learn: Column) -> Model | None:
    """A model of the languages of the documents for which `learn` is true and lang is not null; None without any.

    About SAMPLE_DOCS documents a language are used, drawn by a hash of their doc_id and text,
    and at most SAMPLE_WORDS of their words.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, SAMPLE_DOCS / n)))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0 < share[F.col("lang")]
    labels = sorted(counts)
    by_label: dict[int, list[list[str]]] = {k: [] for k in range(len(labels))}
    for r in rows.filter(drawn).select("lang", "text", "doc_id").orderBy(F.xxhash64("doc_id", "text")).toLocalIterator():
        held = by_label[labels.index(r["lang"])]
        if sum(map(len, held)) < SAMPLE_WORDS:
            held.append(pieces_of(words_of(r["text"])))
    return train(labels, by_label)


def label_documents(docs: DataFrame, model: Model | None, batch_words: int = 1_000_000) -> DataFrame:
    """Per row: doc_id, lang_pred, score, n_words, and switches, the changes of language from word to word.

    The score is the mean probability of lang_pred over the words. A run of more than LONGEST
    letters counts as one word in n_words, and is scored and switches by its pieces. A text that is null or has
    no letter is "und" with score 0. Every row of the input has one row.
    """
    schema = "doc_id long, lang_pred string, score double, n_words long, switches long"

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        emissions = Emissions(model.weights) if model else None

        def flush(ids, texts):
            out = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "lang_pred": "und", "score": 0.0, "n_words": [len(t) for t in texts], "switches": 0})
            texts = [pieces_of(t) for t in texts]
            some = [i for i, t in enumerate(texts) if t]
            if model and some:
                at, table = emissions.rows([texts[i] for i in some])
                lens = np.array([len(texts[i]) for i in some])
                gamma, _ = forward_backward(table[at].astype(float), lens, model.transitions, model.start)
                first = np.cumsum(lens) - lens
                mean = np.add.reduceat(gamma, first, axis=0) / lens[:, None]
                best = gamma.argmax(1)
                change = np.concatenate([[False], best[1:] != best[:-1]])
                change[first] = False
                out.loc[some, "lang_pred"] = [model.labels[k] for k in mean.argmax(1)]
                out.loc[some, "score"] = np.clip(mean.max(1), 0, 1)
                out.loc[some, "switches"] = np.add.reduceat(change.astype(np.int64), first)
            return out

        for b in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(b["doc_id"], b["text"].tolist()):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(words_of(text))
                size += len(texts[-1])
                if size >= batch_words:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield flush(ids, texts)

    return in_batches(docs.select("doc_id", "text"), labelled, schema, rows=10_000)
