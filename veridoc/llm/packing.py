"""Packing documents' ids into windows by non-negative least squares over the length histogram.

A document of n ids is cut into whole windows and one remainder. Remainders are only
counted by length (a histogram of at most WINDOW entries reaches the driver, however many
documents there are). Shallow combinations of lengths that fill a window are enumerated,
non-negative least squares finds how often to use each, the counts are rounded to what the
histogram holds, and the rest is packed largest first. Each remainder then finds its place
by its rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, written
from .tokens import batches_of, encoder

WINDOW = 2048
#: Combinations: copies of one length, lengths taken for threes, and sweeps of the solver.
COPIES, COMMON, SWEEPS = 8, 48, 60
#: Documents in a group that is ranked together.
GROUP_ROWS = 4096


def combinations(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, int], ...]]:
    """Fillings of a window exactly by up to three lengths of the histogram, as ((length, copies), ...)."""
    present = np.flatnonzero(hist)
    here = set(present.tolist())
    found: dict[tuple, None] = {}
    for a in present.tolist():
        for k in range(1, COPIES + 1):
            rest = window - k * a
            if rest == 0:
                found[((a, k),)] = None
            elif rest > 0 and rest in here and rest != a:
                found[tuple(sorted(((a, k), (rest, 1)), reverse=True))] = None
    common = present[np.argsort(-hist[present], kind="stable")][:COMMON].tolist()
    for a in common:
        for b in present.tolist():
            c = window - a - b
            if c > 0 and c in here and a != b != c != a:
                found[tuple(sorted(((a, 1), (b, 1), (c, 1)), reverse=True))] = None
    return list(found)


def solve(hist: np.ndarray, fills: list[tuple[tuple[int, int], ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 with the least sum of squares of (histogram - lengths used), by coordinate descent."""
    left, x = hist.astype(float).tolist(), [0.0] * len(fills)
    norms = [sum(k * k for _, k in fill) for fill in fills]
    for _ in range(sweeps):
        moved = 0.0
        for j, fill in enumerate(fills):
            step = max(-x[j], sum(k * left[a] for a, k in fill) / norms[j])
            if step:
                x[j] += step
                moved += abs(step)
                for a, k in fill:
                    left[a] -= step * k
        if moved < 1e-3 * max(1.0, float(hist.sum())) / max(1, sweeps):
            break
    return np.array(x)


def plan(hist: np.ndarray, window: int = WINDOW) -> tuple[pd.DataFrame, int]:
    """Places for every remainder of a histogram, and the number of sequences.

    A row (length, rank, sequence, copies, offset) starts a run: the i-th remainder of that
    length from `rank` on goes to sequence + i // copies, at offset + length * (i % copies).
    """
    left = hist.astype(np.int64).copy()
    used = np.zeros_like(left)
    rows, sequences = [], 0

    def place(fill, times):
        nonlocal sequences
        offset = 0
        for a, k in fill:
            rows.append((a, int(used[a]), sequences, k, offset))
            used[a] += k * times
            left[a] -= k * times
            offset += a * k
        sequences += times

    fills = combinations(left, window)
    counts = np.rint(solve(left, fills)).astype(np.int64)
    for j in np.argsort(-counts, kind="stable").tolist():
        times = min([int(counts[j]), *(int(left[a]) // k for a, k in fills[j])])
        if times > 0:
            place(fills[j], times)
    while left.any():  # each turn uses up a length, or leaves it fewer than the copies of a turn
        present = np.flatnonzero(left)
        space, fill = window, []
        for a in present[::-1].tolist():
            if k := min(space // a, int(left[a])):
                fill.append((a, k))
                space -= a * k
        place(fill, min(int(left[a]) // k for a, k in fill))
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "copies", "offset"]).astype(np.int64), sequences


def cut(docs: DataFrame, path: str, keeps_space: bool, end_id: int, window: int = WINDOW) -> DataFrame:
    """doc_id, n_tokens, crcs (of its whole windows), rest (length of its remainder) and rest_crc."""

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, keeps_space)
        for b in batches:
            texts, rows = b["text"].tolist(), []
            for i, j in batches_of(texts):
                for ids in enc.encode(texts[i:j]):
                    ids = np.append(ids, np.int32(end_id)).astype("<u4")
                    whole = len(ids) // window
                    crcs = [zlib.crc32(ids[k * window : (k + 1) * window].tobytes()) for k in range(whole)]
                    rows.append((len(ids), crcs, len(ids) - whole * window, zlib.crc32(ids[whole * window :].tobytes())))
            out = pd.DataFrame(rows, columns=["n_tokens", "crcs", "rest", "rest_crc"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    return in_batches(docs.select("doc_id", "text"), cuts, "doc_id long, n_tokens long, crcs array<long>, rest int, rest_crc long")


def ranked(rows: DataFrame, by: list[str], weight: Column, groups: int, order: list[str]) -> DataFrame:
    """Adds _rank: the sum of `weight` over the rows before, among those equal in `by`; no window holds more than a group's rows."""
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int")).withColumn("_w", weight)
    keys = [*by, "_group"]
    within = F.sum("_w").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    totals = dealt.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*by).orderBy("_group").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_total")
    offsets = totals.select(*keys, before.alias("_before"))
    return dealt.withColumn("_within", within).join(offsets, keys).withColumn("_rank", F.col("_within") + F.col("_before")).drop("_group", "_w", "_within", "_before")


def pack(docs: DataFrame, path: str, keeps_space: bool = True, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Every document's pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one end id. Every row of the input is packed, rows of one doc_id
    or without one each for itself. A table without rows has no pieces.
    """
    cuts = written(cut(docs, path, keeps_space, end_id, window), "cuts")
    counts = cuts.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `window` rows
    hist = np.zeros(window, np.int64)
    for r in counts:
        hist[r["rest"]] = r["n"]
    n_docs, hist[0] = int(hist.sum()), 0
    runs, sequences = plan(hist, window)
    runs = runs.sort_values(["length", "rank"])
    first = (runs["length"] * (n_docs + 1) + runs["rank"]).to_numpy()
    steps = {c: runs[c].to_numpy() for c in ("rank", "sequence", "copies", "offset")}
    groups = max(64, n_docs // GROUP_ROWS)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            at = np.searchsorted(first, length * (n_docs + 1) + rank, "right") - 1
            nth, copies = rank - steps["rank"][at], steps["copies"][at]
            yield b.drop(columns="rank").assign(sequence_id=steps["sequence"][at] + nth // copies, offset=steps["offset"][at] + length * (nth % copies))

    order = ["doc_id", "rest_crc", "n_tokens"]
    rests = ranked(cuts.filter("rest > 0").drop("crcs"), ["rest"], F.lit(1).cast("long"), groups, order)
    rests = rests.select("doc_id", (F.col("n_tokens") - F.col("rest")).alias("start"), F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"), F.col("_rank").alias("rank"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rests = in_batches(rests, placed, schema)
    long = cuts.filter(F.size("crcs") > 0).select("doc_id", "n_tokens", "rest_crc", "crcs", F.lit(0).alias("_all"))
    long = ranked(long, ["_all"], F.size("crcs").cast("long"), groups, [*order, "crcs"])
    whole = long.select("doc_id", "n_tokens", "_rank", F.posexplode("crcs").alias("i", "ids_crc32")).select(
        "doc_id",
        (F.col("i").cast("long") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        F.col("n_tokens").alias("doc_tokens"),
        (F.lit(sequences).cast("long") + F.col("_rank") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return rests.unionByName(whole)
