"""Removal of long repeated strings by a logarithmic family of sampled suffix arrays.

A suffix array of every byte with the context to compare it would be some hundred times the
text, so suffixes are sampled: in each window of LENGTH bytes the suffix whose first CORE
bytes have the least hash is its anchor. Equal windows have equal anchors, so a repeat of
LENGTH bytes always shows at an anchor that both copies share. Suffixes are ordered by the
hash of those bytes, not by alphabet: only equality matters, and hashes spread evenly.

Each batch of documents gets its sorted array of anchors, which is merge-scanned against the
levels made so far (and itself) for shared anchors; two levels of equal size merge, so there
are never more levels than the logarithm of the batches. Runs of windows around a shared
anchor are then settled by exact counts at three grains: the whole run, parts of PART
windows, single windows. A run that occurs twice as a whole is settled at once; a run whose
anchor is shared but whose text is not is taken apart. Only counts by hash are shuffled, so
no group of copies is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, in_batches, let_go, written, written_at
from .shingles import mix

LENGTH, CORE, PART = 400, 128, 16
#: Batches of documents, and bytes that are worked on at once.
BATCHES, PORTION = 4, 1 << 18
#: Segs of a core from which it is hot, and hot cores (three longs each) up to which they are broadcast.
HOT_KINDS, BROADCAST_CORES, SALTS = 1000, 500_000, 8
_PLACE = np.uint64(PORTION - 1)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each multiplier and of its inverse modulo 2**64, for PORTION places."""
    if not _TABLES:
        for p in _MULTIPLIERS:
            both = []
            for base in (p, pow(p, -1, 1 << 64)):
                values = np.full(PORTION + 1, base, np.uint64)
                values[0] = 1
                with np.errstate(over="ignore"):
                    both.append(np.cumprod(values))
            _TABLES.append(tuple(both))
    return _TABLES


class RangeHashes:
    """64-bit hashes of any ranges of a portion's bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = []
        with np.errstate(over="ignore"):
            for up, _ in _powers():
                terms = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]
                self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = (stop - start).astype(np.uint64)
        with np.errstate(over="ignore"):
            for sums, (_, down) in zip(self.sums, _powers()):
                out = mix(out * np.uint64(3) + (sums[stop] - sums[start]) * down[start])
        return out


def anchor_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, hash of the anchor's core) of each run of windows with one anchor.

    `ends`: where each text in `data` (at most PORTION bytes) ends; no window spans two.
    """
    n = len(data)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if n < LENGTH:
        return none
    h, width, power = data.astype(np.uint64) + np.uint64(1), 1, _MULTIPLIERS[0]
    with np.errstate(over="ignore"):
        while width < CORE:
            h = h[:-width] + h[width:] * np.uint64(power)
            power, width = power * power % (1 << 64), width * 2
    h = mix(h)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, width = LENGTH - CORE + 1, 1
    while width * 2 <= span:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor = (least & _PLACE).astype(np.int64)
    s = np.arange(len(anchor))
    text = np.searchsorted(ends, s, "right")
    valid = np.flatnonzero(s + LENGTH <= ends[text])
    if not len(valid):
        return none
    a, t = anchor[valid], text[valid]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    last = np.append(new[1:], len(valid)) - 1
    return a[new], valid[new], valid[last], h[a[new]]


def _portions(raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, text's index, its offset) of portions; a long text is cut so that each window is in one portion."""
    held, size = [], 0

    def closed():
        ends = np.cumsum([len(x) for _, _, x in held])
        return np.frombuffer(b"".join(x for _, _, x in held), np.uint8), ends, np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])

    for i, raw in enumerate(raws):
        if len(raw) < LENGTH:
            continue
        for at in range(0, len(raw) - LENGTH + 1, PORTION - LENGTH):
            part = raw[at : at + PORTION - 1]
            if held and size + len(part) >= PORTION:
                yield closed()
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield closed()


def packed(docs: DataFrame) -> DataFrame:
    """rid, doc_id and the compressed UTF-8 text of every row, written; `rid` is the row's own number there."""

    def press(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raws = [t.encode() if t else b"" for t in b["text"]]
            ids = b["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            yield pd.DataFrame({"doc_id": ids, "n_bytes": list(map(len, raws)), "packed": [press.compress(r) for r in raws]})

    rows = in_batches(docs.select("doc_id", "text"), press, "doc_id long, n_bytes long, packed binary")
    return written(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_bytes", "packed"), "packed")


def runs(rows: DataFrame) -> DataFrame:
    """Every run: rid, core, seg (hash of all its windows' bytes), anchor, lo, hi (its windows' starts), batch."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rids = b["rid"].to_numpy()
            for data, ends, index, offset in _portions([zstandard.decompress(bytes(p)) for p in b["packed"]]):
                a, lo, hi, core = anchor_runs(data, ends)
                if not len(a):
                    continue
                k = np.searchsorted(ends, lo, "right")
                shift = offset[k] - (ends - np.diff(ends, prepend=0))[k]
                with np.errstate(over="ignore"):
                    seg = mix(RangeHashes(data).of(lo, hi + LENGTH) * np.uint64(5) + (a - lo).astype(np.uint64))
                rid = rids[index[k]]
                yield pd.DataFrame({"rid": rid, "core": core.view(np.int64), "seg": seg.view(np.int64), "anchor": a + shift, "lo": lo + shift, "hi": hi + shift, "batch": rid % BATCHES})

    return in_batches(rows, found, "rid long, core long, seg long, anchor long, lo long, hi long, batch long")


def shared_cores(found: DataFrame) -> DataFrame:
    """Cores that occur at two anchors at least, from batches of runs by the index family."""
    spark, levels, hits = found.sparkSession, [], []
    for batch in range(BATCHES):
        entries = found.filter(F.col("batch") == batch).groupBy("core").agg(F.count(F.lit(1)).alias("n"))
        array, path = written_at(entries.repartition("core").sortWithinPartitions("core"), "suffixes")
        met = [array.filter("n > 1").select("core")]
        met += [array.join(level.hint("merge"), "core", "left_semi").select("core") for _, level, _ in levels]
        out = met[0]
        for m in met[1:]:
            out = out.unionByName(m)
        hits.append(written(out.distinct(), "shared"))
        size = 1
        while levels and levels[-1][0] == size:
            _, old, old_path = levels.pop()
            merged = old.unionByName(array).groupBy("core").agg(F.sum("n").alias("n"))
            array, new_path = written_at(merged.repartition("core").sortWithinPartitions("core"), "suffixes")
            for p in (old_path, path):
                drop_path(spark, p)
            path, size = new_path, size * 2
        levels.append((size, array, path))
    for _, _, path in levels:
        drop_path(spark, path)
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.distinct()


def sharing(found: DataFrame, shared: DataFrame) -> DataFrame:
    """Runs whose core is shared; the runs of a core are spread over SALTS tasks."""
    salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")
    each = shared.select("core", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return found.withColumn("salt", salt).join(each, ["core", "salt"], "left_semi").drop("salt")


def settle(entries: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(entries whose seg occurs twice, entries to take apart) of entries (core, seg, rid, anchor, lo, hi).

    To take apart: those whose seg is alone under a core that others share, and, as what they
    may equal in part, one entry of every other seg of that core.
    """
    segs = entries.groupBy("core", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "lo")).alias("first"))
    spark = entries.sparkSession
    segs, segs_path = written_at(segs, label)
    cores = segs.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("lone")).filter("kinds > 1")
    cores, cores_path = written_at(cores, label)
    # the segs of a core that very many texts share would meet in one task, so those few cores go to them
    hot = cores.filter(F.col("kinds") > HOT_KINDS)
    if hot.count() <= BROADCAST_CORES:
        hot = F.broadcast(hot)
    cold = segs.join(hot, "core", "left_anti").join(cores, "core", "left")
    known = cold.unionByName(segs.join(hot, "core").select(cold.columns)).fillna(1, ["kinds"]).fillna(0, ["lone"])
    known, known_path = written_at(known.filter("n > 1 or kinds > 1"), label)
    for path in (segs_path, cores_path):
        drop_path(spark, path)
    joined = written(entries.join(known, ["core", "seg"]), label)
    drop_path(spark, known_path)
    columns = [c for c in entries.columns if c != "seg"]
    apart = joined.filter("kinds > 1 and lone > 0 and (n = 1 or (rid = first.rid and lo = first.lo))")
    return joined.filter("n > 1").select(columns), apart.select(columns)


def _parts(segments: DataFrame, single: bool) -> DataFrame:
    """Entries for parts of PART windows, or for single windows, of segments (rid, core, anchor, lo, hi, bytes).

    Parts are laid out from the anchor, so that equal windows fall into the same part; a
    part's core is what all its windows have in common. `from` is the lo of a part's segment,
    which with rid and anchor names it: a long text's portions may part the windows of one anchor.
    """
    step = 1 if single else PART

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            sizes = (b["hi"] - b["lo"] + LENGTH).to_numpy()
            # parts of a run stay in one portion
            portion = np.cumsum(sizes) // (PORTION // 2)
            for _, g in b.groupby(portion):
                data = np.frombuffer(b"".join(g["bytes"]), np.uint8)
                size = (g["hi"] - g["lo"] + LENGTH).to_numpy()
                base = np.cumsum(size) - size - g["lo"].to_numpy()  # place in data of the document's byte 0
                a, lo, hi = (g[c].to_numpy() for c in ("anchor", "lo", "hi"))
                near, far = (a - hi) // step, (a - lo) // step
                count = far - near + 1
                row = np.repeat(np.arange(len(g)), count)
                q = near[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                top = a[row] - q * step  # the part's last window; its first is step - 1 before
                first, last = np.maximum(lo[row], top - step + 1), np.minimum(hi[row], top)
                at, hashes = base[row], RangeHashes(data)
                with np.errstate(over="ignore"):
                    under = mix(g["core"].to_numpy().view(np.uint64)[row] + q.astype(np.uint64))
                    core = mix(under ^ hashes.of(top + at, top - step + 1 + LENGTH + at))
                    seg = mix(core + np.uint64(7) * hashes.of(first + at, last + LENGTH + at) + (top - first).astype(np.uint64))
                yield pd.DataFrame({"rid": g["rid"].to_numpy()[row], "core": core.view(np.int64), "seg": seg.view(np.int64), "anchor": a[row], "lo": first, "hi": last, "from": lo[row]})

    return in_batches(segments, cut, "rid long, core long, seg long, anchor long, lo long, hi long, from long")


def _cut_out(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Segments' bytes of the wanted runs, of which a text has at most one a byte."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("core", "anchor", "lo", "hi")).alias("runs"))
    rows = texts.select("rid", "packed").join(lists, "rid")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, packed_text, found in zip(b["rid"], b["packed"], b["runs"]):
                raw = zstandard.decompress(bytes(packed_text))
                out += [(rid, r["core"], r["anchor"], r["lo"], r["hi"], raw[r["lo"] : r["hi"] + LENGTH]) for r in found]
            yield pd.DataFrame(out, columns=["rid", "core", "anchor", "lo", "hi", "bytes"])

    return in_batches(rows, cut, "rid long, core long, anchor long, lo long, hi long, bytes binary")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(rid, lo, hi): windows from lo to hi of row `rid` of `packed` that also start somewhere else."""
    spark = texts.sparkSession
    found, found_path = written_at(runs(texts.filter(F.col("n_bytes") >= LENGTH).select("rid", "packed")), "runs")
    done, apart = settle(sharing(found.drop("batch"), shared_cores(found)), "runs-settled")
    drop_path(spark, found_path)
    segments, segments_path = written_at(_cut_out(texts, apart), "segments")
    done_parts, loose = settle(_parts(segments, single=False), "parts-settled")
    bounds = loose.groupBy("rid", "anchor", "from").agg(F.collect_list(F.struct("core", "lo", "hi")).alias("parts"))
    again = segments.withColumnRenamed("lo", "from").join(bounds, ["rid", "anchor", "from"]).dropDuplicates(["rid", "anchor", "from"])
    smaller = again.select("rid", "anchor", F.explode("parts").alias("p"), "from", "bytes").select(
        "rid", "p.core", "anchor", "p.lo", "p.hi", F.expr(f"substring(bytes, cast(p.lo - `from` + 1 as int), cast(p.hi - p.lo + {LENGTH} as int))").alias("bytes")
    )
    done_windows, _ = settle(_parts(smaller, single=True), "windows-settled")
    drop_path(spark, segments_path)
    spans = [found.select("rid", "lo", "hi") for found in (done, done_parts, done_windows)]
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes).

    Removes each byte covered by a string of LENGTH bytes that also starts anywhere else in
    any text, the same one included, as the input has them. A null text counts as empty;
    every row has its row, those without doc_id too, and two equal rows repeat each other.
    A table without rows gives none; other columns are not read.
    """
    texts = packed(docs)
    lists = repeated_spans(texts).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = texts.join(lists, "rid", "left")

    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for packed_text, spans in zip(b["packed"], b["spans"]):
                raw = zstandard.decompress(bytes(packed_text))
                if spans is None or not len(spans):
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                    continue
                step = np.zeros(len(raw) + 1, np.int32)
                np.add.at(step, [s["lo"] for s in spans], 1)
                np.add.at(step, [s["hi"] + LENGTH for s in spans], -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                n_spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                out.append((len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.concat([b[["doc_id"]].astype("Int64").reset_index(drop=True), pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])], axis=1)

    return in_batches(joined.select("doc_id", "packed", "spans"), removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
