"""Periodic runs of words, by suffix trees of a document and of its reversal.

Ukkonen's construction gives both trees; the tour around a tree meets the leaves in the order
of their suffixes, and the least depth between two leaves on it is the depth of their lowest
common ancestor, which a sparse table gives in constant time. Every run holds a Lyndon root,
the longest Lyndon word from some position in the order of words or in the reversed one: it
ends before the next suffix that is smaller (greater). Each root is extended to both sides by
the two trees, and what repeats often enough is a run.

Trees are built of the stretches that can hold a run at all: behind a run's first period
every word stood at most a period before, so a stretch of words whose last occurrences lie
that near, at least three periods long, and a period before it, holds the whole run. Nothing
is lost by leaving the rest, which is all of most documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_to, in_batches
from .tokens import batches_of

#: A run has at least so many words, and so many of its periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_FAR = np.int64(1) << 62


class SuffixTree:
    """The order of the suffixes of a list of numbers from 1 on, and the length of what any two have in common."""

    def __init__(self, symbols: list[int]):
        self.rank, turns = _tour(*_ukkonen([*symbols, 0]))
        # the tour's lowest points between neighbouring leaves, and the least of 2^k of them from each on
        self.least = [turns]
        while len(turns) >= 1 << len(self.least):
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-step], last[step:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and j (never the same) share; the end is a suffix too."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        return out


def _ukkonen(s: list[int]) -> tuple[list[int], list[int], list[dict[int, int] | None]]:
    """Start and end of the edge into each node, and the children of each, None of a leaf; the last symbol of `s` is found nowhere else."""
    n = len(s)
    start, end, link, kids = [0], [0], [0], [{}]
    node = edge = length = waiting = 0
    for i, c in enumerate(s):
        waiting += 1
        made = 0
        while waiting:
            if not length:
                edge = i
            own = kids[node]
            kid = own.get(s[edge])
            if kid is None:
                own[s[edge]] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                kids.append(None)
                if made:
                    link[made] = node
                    made = 0
            else:
                begin = start[kid]
                size = end[kid] - begin
                if length >= size:
                    node = kid
                    length -= size
                    edge += size
                    continue
                if s[begin + length] == c:
                    length += 1
                    if made and node:
                        link[made] = node
                    break
                middle = len(start)
                own[s[edge]] = middle
                start += (begin, i)
                end += (begin + length, n)
                link += (0, 0)
                kids += ({s[begin + length]: kid, c: middle + 1}, None)
                start[kid] = begin + length
                if made:
                    link[made] = middle
                made = middle
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return start, end, kids


def _tour(start: list[int], end: list[int], kids: list[dict[int, int] | None]) -> tuple[np.ndarray, np.ndarray]:
    """The rank of every suffix among all, by the tour around the tree, and how deep the tour is at its lowest between neighbouring leaves."""
    n = end[-1]
    leaves, turns = [], []
    stack = [(0, 0, 0)]
    while stack:
        node, depth, turn = stack.pop()
        own = kids[node]
        if own is None:
            leaves.append(n - depth)
            turns.append(turn)
            continue
        first, *rest = sorted(own.items())
        stack += [(kid, depth + end[kid] - start[kid], depth) for _, kid in reversed(rest)]
        kid = first[1]
        stack.append((kid, depth + end[kid] - start[kid], turn))
    rank = np.empty(len(leaves), np.int64)
    rank[leaves] = np.arange(len(leaves))
    return rank, np.array(turns[1:], np.int64)


def lyndon_ends(rank: list[int]) -> tuple[list[int], list[int]]:
    """Where the longest Lyndon word from each position ends, in the order of symbols and in the reversed one."""
    n = len(rank)
    smaller, greater = [n] * n, [n] * n
    low: list[int] = []
    high: list[int] = []
    for i, r in enumerate(rank):
        while low and rank[low[-1]] > r:
            smaller[low.pop()] = i
        while high and rank[high[-1]] < r:
            greater[high.pop()] = i
        low.append(i)
        high.append(i)
    return smaller, greater


def runs_of(symbols: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of the runs in a list of numbers from 1 on, by start, then period; `least_periods` is 2 or more."""
    n = len(symbols)
    if n < max(least_words, least_periods):
        return np.zeros((0, 3), np.int64)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    ends = np.array(lyndon_ends(ahead.rank[:n].tolist()), np.int64).ravel()
    at = np.tile(np.arange(n), 2)
    period = ends - at
    fits = (period * least_periods <= n) & (ends < n)
    at, period = at[fits], period[fits]
    start = at - back.common(n - at, n - at - period)
    length = at + period + ahead.common(at, at + period) - start
    found = np.stack([start, length, period], 1)[length >= np.maximum(least_words, least_periods * period)]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def stretches(ids: np.ndarray, begins: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that hold every run of any document; `begins` are the documents' first places, none of them empty."""
    n = len(ids)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none
    placed = np.sort(ids.astype(np.int64) << 32 | np.arange(n))
    at = placed & 0xFFFFFFFF
    gap = np.full(n, _FAR)
    same = placed[1:] >> 32 == placed[:-1] >> 32
    gap[at[1:][same]] = (at[1:] - at[:-1])[same]
    document = np.repeat(begins, np.diff(begins, append=n))
    gap[gap > np.arange(n) - document] = _FAR  # last seen in another document
    longest = int(np.diff(begins, append=n).max())
    firsts, stops = [], []
    period = 1
    while period * least_periods <= longest:
        most = 2 * period - 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gap <= most, [False]]).view(np.int8)))
        first, stop = edges[::2], edges[1::2]
        long = stop - first >= max(least_words - most, (least_periods - 1) * period)
        firsts.append(np.maximum(first[long] - most, document[first[long]]))
        stops.append(stop[long])
        period *= 2
    if not firsts:
        return none, none
    first, stop = np.concatenate(firsts), np.concatenate(stops)
    if not len(first):
        return none, none
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], first[1:] >= stop[:-1]])
    return first[new], stop[np.append(new[1:], True)]


def runs_in_all(documents: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[np.ndarray]:
    """Rows (start, length, period) of each document's runs of words, by start, then period."""
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for words in documents for w in words], np.int64)
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    begins = np.cumsum(sizes) - sizes
    first, stop = stretches(ids, begins[sizes > 0], least_words, least_periods)
    out = [np.zeros((0, 3), np.int64)] * len(documents)
    owner = np.searchsorted(begins + sizes, first, "right")
    for k in np.unique(owner).tolist():
        mine = np.flatnonzero(owner == k)
        parts, places, at = [], [], 0
        for a, b in zip(first[mine].tolist(), stop[mine].tolist()):
            places.append((at, a - int(begins[k])))
            parts += [*ids[a:b].tolist(), -len(places)]  # a number of its own parts two stretches
            at += b - a + 1
        _, symbols = np.unique(parts, return_inverse=True)
        runs = runs_of((symbols + 1).tolist(), least_words, least_periods)
        where = np.searchsorted([p for p, _ in places], runs[:, 0], "right") - 1
        runs[:, 0] += np.array([q - p for p, q in places], np.int64)[where]
        out[k] = runs
    return out


def _kept(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words).decode()
    steps = [0] * (len(words) + 1)
    for start, length, period in runs.tolist():
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join([w for w, inside in zip(words, accumulate(steps)) if not inside]).decode()


def find_runs(docs: DataFrame, text: Column | None = None, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period) and collapsed (the text without the repeats) of every row.

    Words are what lies between ASCII white space, as they are; a run is a stretch of at least
    `least_words` words and `least_periods` smallest periods that no neighbouring word extends.
    Of each run the first period stays in `collapsed`, whose words are joined by one space. A
    null or empty text has no runs and is empty. Every row is its own, also those without
    doc_id or that repeat others. `text` is the column `text` unless given. A worker holds the
    trees of one document's stretches at once, some 500 bytes a word of theirs.
    """
    source = docs.select("doc_id", (F.col("text") if text is None else text).alias("text"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, ids = b["text"].tolist(), b["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            for i, j in batches_of(texts):
                documents = [(t or "").encode().split() for t in texts[i:j]]
                runs = runs_in_all(documents, least_words, least_periods)
                shown = [[dict(zip(("start", "length", "period"), r)) for r in rows.tolist()] for rows in runs]
                yield pd.DataFrame({"doc_id": ids[i:j], "runs": shown, "collapsed": [_kept(w, r) for w, r in zip(documents, runs)]})

    return in_batches(source, found, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_period(doc_id: Column, text: Column) -> Column:
    """`text`, or where crc32(doc_id) is divisible by 10 its words with a period in them: from a place and of a length that crc32 / 10 fixes."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(ws, a + (i - a) % p))
        return F.when(n > 0, F.concat_ws(" ", F.slice(ws, F.lit(1), a), tail)).otherwise("")

    return F.when((h % 10 == 0) & text.isNotNull(), bound_to(words, planted)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run (greatest length / period, then least start, then period) and digests of the runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # runs come by start, then period, so that only a stronger one takes the place of an earlier one
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
