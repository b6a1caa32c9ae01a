"""Token-id files under Re-Pair grammar compression.

A shard holds the ids of consecutive documents. Frequent pairs of neighbouring symbols are
replaced, again and again, by new nonterminals; no pair spans two documents. The shard
stores the rules and every nonterminal's expansion length, so that any document, or any
range of its ids, is decoded without the rest.

Layout, little-endian: b"RPID", then uint32 version, base (the first nonterminal), n_docs,
n_rules, n_symbols; int64 doc_ids; uint32 symbols of each document; uint32 ids of each
document; uint32 rules (left, right); uint32 expansion lengths; uint32 symbols. The doc_id of
a null is the least int64.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, written
from .tokens import batches_of, encoder

MAGIC, VERSION = b"RPID", 1
#: Ids from which a shard is closed; a document is never cut.
SHARD_IDS = 1_000_000
#: A pair becomes a rule from so many occurrences in its shard; a round takes pairs down to a share of the top count.
MIN_COUNT, ROUND_SHARE = 16, 16
#: Ids and nonterminals of a shard are below this.
MOST_SYMBOLS, BUCKET_BITS = 1 << 16, 18
NULL_ID = np.iinfo(np.int64).min


def compress(ids: np.ndarray, lens: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, symbols of each document, and rules (n x 2) of documents of `lens` ids each, all below `base`.

    A round replaces all the pairs it takes at once; where two of them overlap, the left one
    wins, and every second one in a run. An old pair never becomes more frequent, so a round
    counts what the one before could have taken, and the places next to what it replaced.
    """
    s = ids.astype(np.uint32)
    last = np.zeros(len(s), bool)  # where a document ends
    last[np.cumsum(lens)[lens > 0] - 1] = True
    rules: list[np.ndarray] = []
    top, maybe = base, np.flatnonzero(~last)
    while len(maybe):
        keys = (s[maybe] << np.uint32(16)) | s[maybe + 1]
        # a pair is at most as frequent as its bucket, so the others need no counting
        bucket = ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        often = (np.bincount(bucket, minlength=1 << BUCKET_BITS) >= MIN_COUNT)[bucket]
        maybe, keys, bucket = maybe[often], keys[often], bucket[often]
        ordered = np.sort(keys)
        if not len(ordered):
            break
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(first, len(ordered)))
        most = int(counts.max())
        if most < MIN_COUNT:
            break
        often = np.flatnonzero(counts >= max(MIN_COUNT, most // ROUND_SHARE))
        if len(often) > MOST_SYMBOLS - top:  # the most frequent ones, in the order of the pairs
            often = np.sort(often[np.argsort(-counts[often], kind="stable")[: MOST_SYMBOLS - top]])
        taken = ordered[first[often]]
        if not len(taken):
            break
        place = np.full(1 << BUCKET_BITS, -1, np.int32)  # of a pair among those taken, by bucket
        of_taken = (taken * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
        place[of_taken] = np.arange(len(taken))
        some = np.flatnonzero(place[bucket] >= 0)
        at = place[bucket[some]].astype(np.int64)
        crowded = np.bincount(of_taken, minlength=1 << BUCKET_BITS) > 1
        if crowded.any():
            other = np.flatnonzero(crowded[bucket[some]])
            at[other] = np.minimum(np.searchsorted(taken, keys[some[other]]), len(taken) - 1)
        real = taken[at] == keys[some]
        hits, at = maybe[some[real]], at[real]
        # in a run of overlapping hits every second one is taken
        new_run = np.concatenate([[True], hits[1:] != hits[:-1] + 1])
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
        chosen = (np.arange(len(hits)) - run_start) % 2 == 0
        hits, at = hits[chosen], at[chosen]
        s[hits] = (top + at).astype(np.uint32)
        last[hits] = last[hits + 1]
        keep = np.ones(len(s), bool)
        keep[hits + 1] = False
        place = np.cumsum(keep, dtype=np.int64) - 1
        again = np.zeros(int(place[-1]) + 1, bool)
        again[place[maybe[keep[maybe]]]] = True
        again[place[hits]] = True
        again[np.maximum(place[hits] - 1, 0)] = True
        s, last = s[keep], last[keep]
        maybe = np.flatnonzero(again & ~last)
        rules.append(np.stack([taken >> np.uint32(16), taken & np.uint32(0xFFFF)], 1))
        top += len(taken)
    rule = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    counts = np.zeros(len(lens), np.int64)
    counts[lens > 0] = np.diff(np.flatnonzero(last), prepend=-1)
    return s, counts.astype(np.uint32), rule


def spelled(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What every symbol stands for: its start and length in an array of ids. A rule names only symbols before its own."""
    s = np.arange(base, base + len(rules), dtype=np.int64)
    rule = np.arange(len(rules))
    while len(s) and (big := s >= base).any():
        wide = np.where(big, 2, 1)
        out, at = np.repeat(s, wide), np.cumsum(wide) - wide
        out[at[big]] = rules[s[big] - base, 0]
        out[at[big] + 1] = rules[s[big] - base, 1]
        s, rule = out, np.repeat(rule, wide)
    lens = np.concatenate([np.ones(base, np.int64), np.bincount(rule, minlength=len(rules)).astype(np.int64)])
    return np.concatenate([np.arange(base), s]).astype(np.uint32), np.cumsum(lens) - lens, lens


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that `symbols` stand for."""
    return looked_up(symbols, spelled(rules, base))


def looked_up(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """As `expand`, by a table of `spelled`."""
    ids, starts, lens = table
    n = lens[symbols]
    ends = np.cumsum(n)
    return ids[np.repeat(starts[symbols] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def write_shard(doc_ids: np.ndarray, docs: list[np.ndarray], base: int) -> bytes:
    """A shard's bytes, of documents' ids below `base`; symbols have 16 bits, so ids that have not are refused."""
    lens = np.fromiter(map(len, docs), np.int64, len(docs))
    ids = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    if not 0 < base <= MOST_SYMBOLS or (len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < base):
        raise ValueError(f"ids have to be below base, and base up to {MOST_SYMBOLS}")
    symbols, counts, rules = compress(ids, lens, base)
    sizes = np.ones(len(rules), np.uint32)
    for i, (a, b) in enumerate(rules.tolist()):
        sizes[i] = (1 if a < base else sizes[a - base]) + (1 if b < base else sizes[b - base])
    head = MAGIC + struct.pack("<5I", VERSION, base, len(docs), len(rules), len(symbols))
    arrays = (doc_ids.astype("<i8"), counts.astype("<u4"), lens.astype("<u4"), rules.astype("<u4"), sizes.astype("<u4"), symbols.astype("<u4"))
    return head + b"".join(a.tobytes() for a in arrays)


class Shard:
    """A shard's parts, viewed in place, with decoding of all, one document, or a range of one."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or len(data) < 24:
            raise ValueError("not a shard")
        version, self.base, n_docs, n_rules, n_symbols = struct.unpack_from("<5I", data, 4)
        if version != VERSION or len(data) != 24 + 16 * n_docs + 12 * n_rules + 4 * n_symbols:
            raise ValueError("a shard of another version or length")
        at = 24
        for name, kind, n in (("doc_ids", "<i8", n_docs), ("counts", "<u4", n_docs), ("lens", "<u4", n_docs), ("rules", "<u4", 2 * n_rules), ("sizes", "<u4", n_rules), ("symbols", "<u4", n_symbols)):
            setattr(self, name, part := np.frombuffer(data, kind, n, at))
            at += part.nbytes
        self.rules = self.rules.reshape(-1, 2)
        self.ends = np.cumsum(self.counts, dtype=np.int64)
        self.table = spelled(self.rules, self.base)

    def all_ids(self) -> np.ndarray:
        return looked_up(self.symbols, self.table)

    def ids(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids `start` to `stop` of the i-th document; only symbols that overlap the range are expanded."""
        part = self.symbols[self.ends[i] - self.counts[i] : self.ends[i]].astype(np.int64)
        stop = int(self.lens[i]) if stop is None else min(stop, int(self.lens[i]))
        big = part >= self.base
        size = np.ones(len(part), np.int64)
        size[big] = self.sizes[part[big] - self.base]
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return looked_up(part[a:b], self.table)[start - before : max(start, stop) - before]


def write_ids(docs: DataFrame, path: str, keeps_space: bool, end_id: int, base: int) -> DataFrame:
    """A table of shards (part, shard, n_ids, content binary) of all texts, in ascending doc_id order.

    A null text has only the end id. Null doc_ids come first; equal ones stand side by side.
    """

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, enc = TaskContext.get().partitionId(), encoder(path, keeps_space)
        names, held, size, number = [], [], 0, 0

        def closed():
            nonlocal names, held, size, number
            row = pd.DataFrame({"part": [part], "shard": [number], "n_ids": [size], "content": [write_shard(np.array(names, np.int64), held, base)]})
            names, held, size, number = [], [], 0, number + 1
            return row

        for b in batches:
            texts, doc_ids = b["text"].tolist(), b["doc_id"].tolist()
            for i, j in batches_of(texts):
                for doc_id, ids in zip(doc_ids[i:j], enc.encode(texts[i:j])):
                    names.append(NULL_ID if pd.isna(doc_id) else int(doc_id))
                    held.append(np.append(ids, np.int32(end_id)))
                    size += len(held[-1])
                    if size >= SHARD_IDS:
                        yield closed()
        if held:
            yield closed()

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(in_batches(rows, shards, "part int, shard int, n_ids long, content binary"), "token-ids")


def read_ids(shards: DataFrame) -> DataFrame:
    """Per document, from a table of shards: doc_id, start (ids of all before it), n_tokens, ids_crc32."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, number, content in zip(b["part"], b["shard"], b["content"]):
                shard = Shard(bytes(content))
                ids, ends = shard.all_ids(), np.cumsum(shard.lens, dtype=np.int64)
                starts = ends - shard.lens
                crcs = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(starts.tolist(), ends.tolist())]
                names = pd.array(shard.doc_ids, dtype="Int64")
                names[shard.doc_ids == NULL_ID] = pd.NA
                yield pd.DataFrame({"part": part, "shard": number, "doc_id": names, "at": starts, "n_tokens": shard.lens.astype(np.int64), "ids_crc32": np.array(crcs, np.int64), "n_symbols": shard.counts.astype(np.int64)})

    rows = in_batches(shards.select("part", "shard", "content"), documents, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long, n_symbols long")
    sizes = shards.select("part", "shard", "n_ids")
    in_part = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    offsets = sizes.select("part", "shard", in_part.alias("within")).join(parts, "part")
    out = rows.join(offsets, ["part", "shard"])
    return out.select("doc_id", (F.col("before") + F.col("within") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "n_symbols")
