"""Benchmark decontamination by SimHash of item-sized windows.

Benchmark items fall into classes of about the same number of shingles. Every document is
read through windows of each class's size; a window's 128-bit SimHash is looked up among the
class's items. Multi-index blocks find every item within RADIUS bits: the 16 bytes of two
fingerprints within 41 bits of each other can't all but two differ by three bits or more
(14 x 3 > 41), so three bytes at least are within two bits, which tables by byte value tell.
A candidate is confirmed by the exact weighted similarity of the shingles of the item and of
the best window of the item's own size near by. A shingle weighs as many units as it has
bytes, times its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, let_go, written
from .shingles import mix, shingle_hashes, word_hashes, words_of_all

BITS, RADIUS, NEAR_BITS, NEAR_BYTES = 128, 41, 2, 3
#: Items in a class differ by this ratio in size; windows step by 1/STEPS of theirs.
RATIO, STEPS = 1.15, 8
#: Items that one pass over the documents looks for, items of one lookup, and words that are worked on at once.
BLOCK_ITEMS, LOOKUP_ITEMS, BATCH_WORDS = 4096, 64, 60_000


@dataclass
class Item:
    item_id: int
    hashes: np.ndarray  # sorted distinct shingles
    weights: np.ndarray
    size: int  # shingles, repeats included


def simhashes(sums: np.ndarray) -> np.ndarray:
    """Fingerprints (n x 16 bytes) of n x BITS signed sums."""
    return np.packbits(sums > 0, axis=1)


def signs(hashes: np.ndarray) -> np.ndarray:
    """n x BITS of +1 or -1, by two hashes of each shingle."""
    both = np.stack([mix(hashes), mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _weights(lens: np.ndarray, k: int) -> np.ndarray:
    """Bytes of each shingle: its words and a space after each."""
    sums = np.concatenate([[0], np.cumsum(lens + 1)])
    return sums[k:] - sums[:-k]


class Shingles:
    """A set of hashes; a table of bits by their high part tells most of the others from them."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        bits = min(24, max(12, len(self.sorted).bit_length() + 4))
        self.shift, self.table = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.table[(self.sorted >> self.shift).astype(np.int64)] = True

    def members(self, hashes: np.ndarray) -> np.ndarray:
        """The places of `hashes` that are in the set."""
        maybe = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        at = np.searchsorted(self.sorted, hashes[maybe])
        at[at == len(self.sorted)] = 0
        return maybe[self.sorted[at] == hashes[maybe]]


class Lookup:
    """Up to LOOKUP_ITEMS items of one class, by the bytes of their fingerprints."""

    def __init__(self, items: list[Item], prints: np.ndarray):
        self.items, self.prints = items, prints.view(np.uint64)
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= NEAR_BITS
        bit = np.uint64(1) << np.arange(len(items), dtype=np.uint64)
        self.tables = [np.where(near[:, prints[:, b]], bit, np.uint64(0)).sum(1, dtype=np.uint64) for b in range(BITS // 8)]

    def within(self, prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item's index, rows) of every fingerprint within RADIUS of an item's."""
        levels = [np.zeros(len(prints), np.uint64) for _ in range(NEAR_BYTES)]
        for b, table in enumerate(self.tables):
            hit = table[prints[:, b]]
            for k in range(NEAR_BYTES - 1, 0, -1):
                levels[k] |= levels[k - 1] & hit
            levels[0] |= hit
        wide = prints.view(np.uint64)
        for j in range(len(self.items)):
            rows = np.flatnonzero(levels[-1] & (np.uint64(1) << np.uint64(j)))
            if len(rows):
                bits = np.bitwise_count(wide[rows] ^ self.prints[j]).sum(1)
                rows = rows[bits <= RADIUS]
                if len(rows):
                    yield j, rows


class Index:
    """The items of a block, by shingle length and class of size."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        by_k: dict[int, list[tuple[Item, np.ndarray]]] = {}
        for item_id, text in items:
            w = word_hashes(text)
            if not len(w):
                continue
            k = min(words, len(w))
            h, lens = shingle_hashes(w, k), words_of_all([text])[2]
            weight = _weights(lens, k)
            known, at = np.unique(h, return_inverse=True)
            total = np.bincount(at, weight).astype(np.int64)
            print_ = simhashes((signs(h) * weight[:, None]).sum(0, keepdims=True))
            by_k.setdefault(k, []).append((Item(item_id, known, total, len(h)), print_))
        self.classes: dict[int, list[tuple[int, list[Lookup]]]] = {}
        self.shingles: dict[int, Shingles] = {}
        for k, found in by_k.items():
            found.sort(key=lambda x: x[0].size)
            self.shingles[k] = Shingles(np.concatenate([i.hashes for i, _ in found]))
            while found:
                n = sum(i.size <= found[0][0].size * RATIO for i, _ in found)
                part, found = found[:n], found[n:]
                size = (part[0][0].size + part[-1][0].size) // 2
                chunks = [part[i : i + LOOKUP_ITEMS] for i in range(0, n, LOOKUP_ITEMS)]
                self.classes.setdefault(k, []).append((size, [Lookup([i for i, _ in c], np.concatenate([p for _, p in c])) for c in chunks]))


def _similarity(item: Item, hashes: np.ndarray, weights: np.ndarray) -> float:
    """Weighted Jaccard similarity of an item and a window's shingles."""
    known, at = np.unique(hashes, return_inverse=True)
    total = np.bincount(at, weights)
    where = np.searchsorted(item.hashes, known)
    where[where == len(item.hashes)] = 0
    both = item.hashes[where] == known
    shared = np.minimum(item.weights[where[both]], total[both]).sum()
    return float(shared / (item.weights.sum() + total.sum() - shared))


def _best(item: Item, starts: np.ndarray, high: int, hashes: np.ndarray, weights: np.ndarray, threshold: float) -> tuple[float, int] | None:
    """(similarity, start) of the item's best window among those that start at `starts` and end by `high`, the first of equals.

    A window shares at most the weight of those of its shingles that the item has too; windows
    are compared exactly in the order of the similarity that this allows, as long as it can win.
    """
    low = int(starts[0])
    part, weight = hashes[low:high], weights[low:high]
    where = np.searchsorted(item.hashes, part)
    where[where == len(item.hashes)] = 0
    sums = np.concatenate([[0], np.cumsum(weight)])
    owned = np.concatenate([[0], np.cumsum(weight * (item.hashes[where] == part))])
    begin, end = starts - low, np.minimum(starts + item.size, high) - low
    mine, total = int(item.weights.sum()), sums[end] - sums[begin]
    most = np.minimum(owned[end] - owned[begin], np.minimum(mine, total))
    bound = most / (mine + total - most)
    found = None
    for j in np.lexsort((starts, -bound)).tolist():
        if bound[j] < (found[0] if found else threshold) - 1e-9:
            break
        s = _similarity(item, part[begin[j] : end[j]], weight[begin[j] : end[j]])
        if s >= threshold and (found is None or (s, -starts[j]) > (found[0], -found[1])):
            found = (s, int(starts[j]))
    return found


def search(index: Index, words: np.ndarray, doc: np.ndarray, lens: np.ndarray, threshold: float) -> list[tuple[int, int, float, int]]:
    """(document's number, item_id, similarity, first word's place in `words`) of each pair's best window, of words of documents in turn.

    A window that shares no shingle with any item has no similarity with one, so fingerprints
    are made only of windows that hold a shingle of the items'.
    """
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for k, classes in index.classes.items():
        n = len(words) - k + 1
        if n < 1:
            continue
        at = np.flatnonzero(doc[:n] == doc[k - 1 :])  # shingles within a document
        h = shingle_hashes(words, k)[:n][at]
        hits = index.shingles[k].members(h)
        if not len(hits):
            continue
        weight, of = _weights(lens, k)[at], doc[at]
        ends, first = np.searchsorted(of, of, "right"), np.searchsorted(of, of, "left")
        shared = np.zeros(len(h) + 1, np.int64)
        shared[hits + 1] = 1
        np.cumsum(shared, out=shared)
        reach = max(size for size, _ in classes)
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, np.maximum(first[hits], hits - reach), 1)
        np.add.at(edge, np.minimum(ends[hits], hits + reach + 1), -1)
        near = np.cumsum(edge[:-1]) > 0
        kind = np.int32 if int(weight.sum()) < 1 << 31 else np.int64
        sums = np.zeros((int(near.sum()) + 1, BITS), kind)
        np.cumsum(signs(h[near]) * weight[near, None].astype(kind), axis=0, out=sums[1:])
        row = np.concatenate([[0], np.cumsum(near)])  # of a shingle's place among `sums`
        place = np.arange(len(h))
        for size, lookups in classes:
            step = max(1, size // STEPS)
            start = place[(place - first) % step == 0]
            stop = np.minimum(start + size, ends[start])
            # a window cut by the document's end must still be able to reach the threshold
            fits = ((stop - start) * RATIO * RATIO >= threshold * size) & (shared[stop] > shared[start])
            start, stop = start[fits], stop[fits]
            prints = simhashes(sums[row[stop]] - sums[row[start]])
            for lookup in lookups:
                for j, rows in lookup.within(prints):
                    item, mark = lookup.items[j], np.zeros(len(h) + 1, np.int64)
                    from_ = start[rows]
                    span = step + abs(size - item.size)
                    low = np.maximum(first[from_], from_ - span)
                    top = np.maximum(low, np.minimum(from_ + span, ends[from_] - item.size))
                    np.add.at(mark, low, 1)
                    np.add.at(mark, top + 1, -1)
                    starts = np.flatnonzero(np.cumsum(mark[:-1]))
                    for part in np.split(starts, np.flatnonzero(np.diff(of[starts])) + 1):
                        high = int(min(ends[part[0]], part[-1] + item.size))
                        if shared[high] == shared[part[0]]:
                            continue
                        found = _best(item, part, high, h, weight, threshold)
                        key = (int(of[part[0]]), item.item_id)
                        if found and (found[0], -int(at[found[1]])) > best.get(key, (0.0, 0)):
                            best[key] = (found[0], -int(at[found[1]]))
    return [(d, item, s, -p) for (d, item), (s, p) in best.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document and item of which it has a window: doc_id, item_id, similarity, start_word.

    The similarity is that of the best window, start_word the number of words before it. Items
    of fewer than `words` words are one shingle; items and texts that are null or without
    words match nothing, and neither do rows without item_id or doc_id. Items are taken in
    blocks of about BLOCK_ITEMS, one after another, each of which is one pass over the
    documents. Rows that share a doc_id are searched each for itself, and the best window
    counts; so it is with rows that share an item_id. Tables without rows give none.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    schema = "doc_id long, item_id long, similarity double, start_word long"

    def searched(block: list[tuple[int, str]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            let_go()
            index = Index(block, words)
            margin = words + max((size for c in index.classes.values() for size, _ in c), default=0) * 2
            for b in batches:
                found, ids = [], b["doc_id"].tolist()
                for part, offsets, w, d, lens in _portions(b["text"].tolist(), margin):
                    begin = np.searchsorted(d, np.arange(len(part)))
                    for n, item, s, p in search(index, w, d, lens, threshold):
                        found.append((ids[part[n]], item, s, int(p - begin[n] + offsets[n])))
                if found:
                    yield pd.DataFrame(found, columns=["doc_id", "item_id", "similarity", "start_word"])

        return run

    out = spark.createDataFrame([], schema)
    for i in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else items
        found = in_batches(rows, searched([tuple(r) for r in block.collect()]), schema)
        out = found if blocks == 1 else out.unionByName(written(found, "leaks"))
    top = F.max(F.struct("similarity", (-F.col("start_word")).alias("at"))).alias("top")
    return out.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "top.similarity", (-F.col("top.at")).alias("start_word"))


def _portions(texts: list[str], margin: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in portions of about BATCH_WORDS words: their indexes, first words, and the words with portion-wise numbers.

    A longer text is cut into stretches that overlap by `margin` words.
    """
    held, size = [], 0
    for i, t in enumerate(texts):
        if len(t) > BATCH_WORDS * 6:
            w, _, lens = words_of_all([t])
            for at in range(0, max(1, len(w) - margin), BATCH_WORDS):
                part = slice(at, at + BATCH_WORDS + margin)
                yield [i], [at], w[part], np.zeros(len(w[part]), np.int64), lens[part]
            continue
        held.append(i)
        size += len(t)
        if size > BATCH_WORDS * 6:
            yield held, [0] * len(held), *words_of_all([texts[j] for j in held])
            held, size = [], 0
    if held:
        yield held, [0] * len(held), *words_of_all([texts[j] for j in held])
