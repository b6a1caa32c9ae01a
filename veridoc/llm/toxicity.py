"""Toxicity by compression distance between two zstandard dictionaries.

The ordinary dictionary is made of ordinary words; the toxic one is the same text with words
of toxic documents after it, so that their difference in compressing a window shows only what
toxic text explains. A window is one word in a fixed frame of common words, which the
compressor needs to be able to code a match at all.

A second pair of dictionaries, of equal size, holds passages of toxic and of ordinary
documents, words in their order. The whole text is compressed by both in windows of
WINDOW words, of which neighbours share some. The largest two differences of either pair, the
mean over windows and the number of distinct words give, by a logistic model fitted on
labelled documents that the dictionaries have not seen, a document's score.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, in_batches, written

#: Fit bounds: labelled documents of either kind, words of either kind, and bytes of either text.
SAMPLE_ROWS, TOXIC_WORDS, ORDINARY_WORDS = 2500, 4000, 120_000
TOXIC_BYTES, ORDINARY_BYTES = 65_536, 400_000
#: A word is toxic from so many documents (and this share of the toxic ones), at this log ratio of the two shares.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 3, 0.005, 3.0
#: Of each CALIBRATION_OF labelled documents one is kept from the dictionaries, for the calibration.
CALIBRATION_OF = 3
SHORTEST_MATCH, TOP = 5, 9
#: Bytes of each dictionary of passages, characters of a document in it at least, words of a window and from one to the next.
PASSAGE_BYTES, PASSAGE_CHARS, WINDOW, WINDOW_STEP = 524_288, 400, 16, 8
#: Differences of windows beyond so many bytes count as that.
FAR = 60
SIZE = 2 * (TOP + 2) + 5
CACHED_WORDS = 600_000
WORD = r"[\p{L}\p{N}_]+"
_WORD = re.compile(r"\w+")


def _press(text: bytes) -> zstandard.ZstdCompressor:
    loaded = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(
        13, window_log=20, hash_log=17, chain_log=19, search_log=10, min_match=SHORTEST_MATCH, target_length=64,
        strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    loaded.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=loaded, compression_params=params)


def _press_passages(text: bytes) -> zstandard.ZstdCompressor:
    loaded = zstandard.ZstdCompressionDict(b" the words " + text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(
        3, window_log=20, hash_log=19, chain_log=18, search_log=3, min_match=SHORTEST_MATCH, target_length=64,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    loaded.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=loaded, compression_params=params)


def windows(words: list[str]) -> list[bytes]:
    """Windows of WINDOW words that cover all of `words`."""
    return [" ".join(words[i : i + WINDOW]).encode() for i in range(0, max(1, len(words) - WINDOW + WINDOW_STEP), WINDOW_STEP)] if words else []


@dataclass
class Model:
    """Texts of the two dictionaries of words and the two of passages, the frame around a word, and the logistic weights."""

    ordinary: bytes
    toxic: bytes
    before: bytes
    after: bytes
    ordinary_passages: bytes = b""
    toxic_passages: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SIZE))

    @classmethod
    def of(cls, ordinary: list[str], toxic: list[str], passages: tuple[list[str], list[str]]) -> Model:
        """From words, the most frequent first, and ordinary and toxic passages. Later text is nearer to a window, so it comes last."""
        common = (ordinary * 12)[:12] if ordinary else ["the"] * 12
        before, after = " ".join(common[:8]).encode() + b" ", b" " + " ".join(common[8:]).encode() + b" "
        text = lambda ws, size: (" " + " ".join(reversed(ws)) + " ").encode()[-size:]
        both = [" ".join(p).encode() for p in passages]
        size = min(PASSAGE_BYTES, *map(len, both))  # equal, so that neither has more to offer by chance
        return cls(text(ordinary, ORDINARY_BYTES), text(toxic, TOXIC_BYTES), before, after, *(b[:size] for b in both))

    def opened(self) -> Distances:
        """The model's distances in this worker, kept from task to task."""
        key = tuple(map(zlib.crc32, (self.ordinary, self.toxic, self.ordinary_passages, self.toxic_passages)))
        frame = self.after + self.before
        return held(key, lambda: Distances(self, _press(self.ordinary + frame), _press(self.ordinary + self.toxic + frame)))


class Distances:
    """Compression distances of words under a model, each computed once."""

    def __init__(self, model: Model, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor):
        self.model, self.ordinary, self.toxic, self.known = model, ordinary, toxic, {}
        text = model.toxic
        self.passages = _press_passages(model.ordinary_passages), _press_passages(model.toxic_passages)
        self.matchable = {text[i : i + SHORTEST_MATCH] for i in range(len(text) - SHORTEST_MATCH + 1)}

    def of(self, words: set[str]) -> list[int]:
        """How many bytes fewer the toxic dictionary needs for each word's window.

        Where the word and the spaces around it share no shortest match with toxic text, the
        two have the same text to offer, and the difference is 0.
        """
        known, m, matchable = self.known, self.model, self.matchable
        for w in [w for w in words if w not in known]:
            raw = w.encode()
            inner = b" " + raw + b" "
            if matchable.isdisjoint([inner[i : i + SHORTEST_MATCH] for i in range(len(inner) - SHORTEST_MATCH + 1)]):
                known[w] = 0
                continue
            window = m.before + raw + m.after
            known[w] = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        return [known[w] for w in words]

    def features(self, text: str | None) -> np.ndarray:
        """One-hot largest and second largest distance, those of windows and their mean, log of distinct words, and 1."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        found = _WORD.findall((text or "").lower())
        words = set(found)
        best = heapq.nlargest(2, self.of(words))
        out = np.zeros(SIZE)
        for i in range(2):
            d = best[i] if i < len(best) else -1
            out[i * (TOP + 2) + 1 + max(-1, min(TOP, d))] = 1
        if found and self.model.toxic_passages:
            plain, toxic = (p.compress for p in self.passages)
            far = [max(-FAR, min(FAR, len(plain(w)) - len(toxic(w)))) for w in windows(found)]
            largest = heapq.nlargest(2, far)
            out[-5], out[-4], out[-3] = largest[0] / 10, largest[-1] / 10, sum(far) / len(far) / 10
        out[-2], out[-1] = math.log1p(len(words)) / 10, 1
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w - np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> Model:
    """A model from the labelled documents for which `held_out` (of doc_id) is not true.

    At most SAMPLE_ROWS documents of each label are used, those with the least hashes of their
    doc_id; where a doc_id has several labels, the highest holds. Exact copies count once.
    The calibration uses dictionaries from which its documents are kept; the model returned has
    those of all. Without toxic documents the model scores everything near zero.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & ~F.coalesce(held_out, F.lit(True)))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).withColumn("_hash", F.xxhash64("doc_id"))
    ids = [known.filter(F.col("_toxic") == k).orderBy("_hash").limit(SAMPLE_ROWS) for k in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]))
    own = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION_OF)) == 0
    sample = docs.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id")
    sample = written(sample.dropDuplicates(["text"]).select("text", "_toxic", own.alias("_own")), "toxic-sample")
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("word")
    fit_only = F.when(F.col("_own"), 0).otherwise(1)
    # documents of either label with a word: among those that the calibration leaves, and among all
    sums = {"t_fit": F.col("_toxic") * fit_only, "o_fit": (1 - F.col("_toxic")) * fit_only, "t_all": F.col("_toxic"), "o_all": 1 - F.col("_toxic")}
    totals = sample.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(k) for k, x in sums.items())).first()
    counts = sample.select("_toxic", "_own", words).groupBy("word").agg(*(F.sum(x).alias(k) for k, x in sums.items()))
    counts = written(counts.filter("t_all + o_all > 1"), "toxic-words")
    # of each document a passage, the longer the fewer there are
    text = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), " ")
    share = F.when(F.col("_toxic") == 1, max(PASSAGE_CHARS, PASSAGE_BYTES // max(1, totals["t_fit"])))
    share = share.otherwise(max(PASSAGE_CHARS, PASSAGE_BYTES // max(1, totals["o_fit"])))
    sized = sample.select("_toxic", "_own", F.xxhash64("text").alias("_hash"), text.alias("text"), share.alias("_share"))
    start = F.pmod(F.col("_hash"), F.greatest(F.lit(1), F.length("text") - F.col("_share") + 1)).cast("int")
    passages = sized.withColumn("text", F.substring(F.col("text"), start + 1, F.col("_share"))).orderBy("_hash").select("text", "_toxic", "_own").collect()
    models = []
    for part in ("fit", "all"):
        of_part = [[r["text"] for r in passages if r["_toxic"] == k and not (part == "fit" and r["_own"])] for k in (0, 1)]
        t, o, n = F.col(f"t_{part}"), F.col(f"o_{part}"), totals[f"t_{part}"]
        odds = F.log((t + 0.5) / (n + 1)) - F.log((o + 0.5) / (totals[f"o_{part}"] + 1))
        least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * n))
        toxic = counts.filter((t >= least) & (odds > LEAST_ODDS)).orderBy(t.desc(), "word").limit(TOXIC_WORDS)
        plain = counts.filter((o > 0) & (odds < 1)).orderBy(o.desc(), "word").limit(ORDINARY_WORDS)
        models.append(Model.of(*([r["word"] for r in found.select("word").collect()] for found in (plain, toxic)), of_part))
    model = models[0]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = model.opened()
        for b in batches:
            yield pd.DataFrame({"x": [opened.features(t).tolist() for t in b["text"]], "y": b["_toxic"].astype("float64")})

    rows = in_batches(sample.filter("_own"), features, "x array<double>, y double").collect()
    x, y = np.array([r["x"] for r in rows]).reshape(-1, len(model.weights)), np.array([r["y"] for r in rows])
    if len(rows) and y.any():
        models[1].weights = _logistic(x, y)
    else:
        models[1].weights[-1] = -4.0
    return models[1]


def score(docs: DataFrame, model: Model, into: str = "_score") -> DataFrame:
    """`docs` with `into`, from 0 to 1: higher where toxicity is likelier. A null text counts as empty.

    Every row has its score, also those without doc_id or that repeat others; a column named as `into` gives way to it.
    """
    docs = docs.drop(into)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = model.opened()
        for b in batches:
            x = np.array([opened.features(t) for t in b["text"]]).reshape(-1, len(model.weights))
            yield b.assign(**{into: 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))})

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return in_batches(docs, scored, f"{names}, `{into}` double")


def held_out(doc_id: Column, of: int) -> Column:
    """Whether the crc32 of the doc_id as text is divisible by `of`; null where the doc_id is."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of == 0
