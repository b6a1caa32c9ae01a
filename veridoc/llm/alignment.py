"""Alignment of two tokenizers' ids of the same text, and how many documents link an id pair.

Both tokenizations are cut into groups where a token of either ends at the same byte. The
ends are compared along a diagonal, the current shift between the two indexes: blocks of
doubling width skip stretches of one-to-one tokens, the first difference is found by halving,
and the group there is walked token by token, which gives the shift of the next diagonal.

A space between two other characters always parts tokens of either vocabulary, so a text is
the sequence of its chunks between spaces, and a chunk is tokenized and aligned once per
worker. A text with other white space next to a space, or a space at an end, is taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, held, in_batches, written
from .shingles import span_hashes
from .tokens import BYTE_VALUES, ChunkEncoder, IdLists, Known, batches_of, byte_decoded

#: Up to so many id pairs (of 13 bytes each) the counts are sent to every worker; more are joined.
BROADCAST_PAIRS = 4_000_000
#: In the join, pairs that one document of so many holds are few (so many times the pairs of a document) and are broadcast.
HOT_SHARE = 100
#: Chunks a worker knows before it starts anew, and pairs counted in a task before they are handed on.
MOST_CHUNKS, PAIRS_AT_ONCE = 500_000, 2_000_000
_EMPTY = np.zeros(0, np.int64)


def diagonal_groups(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Groups and links of two tokenizations of the same bytes, by the ends of their tokens.

    Gives for each group the index after its last token of either side, and for each link the
    index of its token of either side.
    """
    i = j = 0
    n, m = len(ends_a), len(ends_b)
    stops_a: list[int] = []
    stops_b: list[int] = []
    links_a: list[int] = []
    links_b: list[int] = []
    while i < n:
        shift, first, width = j - i, i, 1
        while i < n:
            stop = min(i + width, n, m - shift)
            if stop > i and ends_a[i:stop] == ends_b[i + shift : stop + shift]:
                i = stop
                width *= 2
                continue
            while stop - i > 1:  # the first difference is in i..stop
                half = (i + stop) // 2
                if ends_a[i:half] == ends_b[i + shift : half + shift]:
                    i = half
                else:
                    stop = half
            break
        j = i + shift
        if i > first:
            stops_a += range(first + 1, i + 1)
            stops_b += range(first + shift + 1, j + 1)
            links_a += range(first, i)
            links_b += range(first + shift, j)
        if i == n:
            break
        while True:
            links_a.append(i)
            links_b.append(j)
            a, b = ends_a[i], ends_b[j]
            if a <= b:
                i += 1
            if b <= a:
                j += 1
            if a == b:
                break
        stops_a.append(i)
        stops_b.append(j)
    return stops_a, stops_b, links_a, links_b


class Aligner:
    """Ids by both vocabularies, links and groups of texts, with chunks that repeat looked up."""

    def __init__(self, path_a: str, path_b: str, max_chunks: int = MOST_CHUNKS):
        import sentencepiece

        self.a = ChunkEncoder(path_a, keeps_space=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = byte_decoded(self.a.tok)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.bytes_a) * len(self.bytes_b) >= 1 << 31:
            raise ValueError("the two vocabularies have more than 2^31 pairs")
        # no piece may span the space between two chunks
        self.by_chunks = not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.max_chunks = max_chunks
        self._clear()

    def _clear(self) -> None:
        self.known, self.links, self.shown = Known(), IdLists(), []
        self.counts = np.zeros((4, 1024), np.int64)

    def _aligned(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[list[int], np.ndarray, list[str]]:
        """Of ids that spell the same bytes: how many a-tokens each group ends after, the links' pair keys, and the groups as text."""
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        stops_a, stops_b, links_a, links_b = diagonal_groups(ends_a.tolist(), ends_b.tolist())
        keys = ids_a[links_a].astype(np.int64) * len(self.bytes_b) + ids_b[links_b]
        said_a, said_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        shown, i, j = [], 0, 0
        for k, l in zip(stops_a, stops_b):
            shown.append(f"{said_a[i]}|{said_b[j]}" if k - i == 1 == l - j else f"{','.join(said_a[i:k])}|{','.join(said_b[j:l])}")
            i, j = k, l
        return stops_a, keys, shown

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """Numbers of new chunks, each tokenized with a space before it; one to be taken whole gets -1 a-tokens, one whose bytes differ -2."""
        flat_a, lens_a = self.a.chunk_ids(chunks)
        found = self.b.encode(chunks, num_threads=1)
        lens_b = np.fromiter(map(len, found), np.int64, len(found))
        flat_b = np.array([i for ids in found for i in ids], np.int64)
        good = lens_a >= 0
        raw = [b" " + c.encode() for c in chunks]
        stops_a, stops_b = np.cumsum(np.maximum(lens_a, 0)), np.cumsum(lens_b)
        spelled_a, spelled_b = (b"".join(map(t.__getitem__, f.tolist())) for t, f in ((self.bytes_a, flat_a), (self.bytes_b, flat_b)))
        want = b"".join(raw)
        if not (good.all() and spelled_a == spelled_b == want):
            for k in np.flatnonzero(good).tolist():
                mine_a = flat_a[stops_a[k] - lens_a[k] : stops_a[k]].tolist()
                mine_b = flat_b[stops_b[k] - lens_b[k] : stops_b[k]].tolist()
                if not b"".join(self.bytes_a[i] for i in mine_a) == b"".join(self.bytes_b[i] for i in mine_b) == raw[k]:
                    lens_a[k] = -2
            good = lens_a >= 0
            flat_a, flat_b = flat_a[np.repeat(good, np.diff(stops_a, prepend=0))], flat_b[np.repeat(good, lens_b)]
        lens_b = np.where(good, lens_b, 0)
        stops, keys, shown = self._aligned(flat_a, flat_b)
        cuts = np.searchsorted(stops, np.cumsum(np.maximum(lens_a, 0)), "right")  # chunks end where groups do
        groups = np.diff(cuts, prepend=0)
        first, at = self.links.count, 0
        self.links.add_flat(keys.astype(np.int32), np.maximum(lens_a, 0) + lens_b - groups)
        for k in cuts.tolist():
            self.shown.append(";".join(shown[at:k]).encode())
            at = k
        while first + len(chunks) > self.counts.shape[1]:
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)], 1)
        self.counts[:, first : first + len(chunks)] = lens_a, lens_b, groups, self.links.lens[first : self.links.count]
        return np.arange(first, first + len(chunks), dtype=np.int32)

    def _whole(self, text: str) -> tuple[int, int, int, np.ndarray, bytes]:
        """Tokens of either side, groups, pair keys of the links and the groups as text, of one text as it is."""
        ids_a = np.array(self.a.tok.encode(" " + text, add_special_tokens=False).ids, np.int64)
        ids_b = np.array(self.b.encode(text, num_threads=1), np.int64)
        if not b"".join(map(self.bytes_a.__getitem__, ids_a)) == b"".join(map(self.bytes_b.__getitem__, ids_b)) == b" " + text.encode():
            return 0, 0, 0, _EMPTY, b""
        _, keys, shown = self._aligned(ids_a, ids_b)
        return len(ids_a), len(ids_b), len(shown), keys, ";".join(shown).encode()

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, np.ndarray, bytes]]:
        """For each text its a-tokens, b-tokens, groups, pair keys of its links, and its groups as text; zeros where it has no tokens."""
        if self.links.count > self.max_chunks:
            self._clear()
        whole = set() if self.by_chunks else {i for i, t in enumerate(texts) if t}
        raws = [b"" if not t or i in whole else t.encode() for i, t in enumerate(texts)]
        data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        bounds = np.append(np.searchsorted(starts, np.cumsum(sizes) - sizes), len(starts))
        hashes = span_hashes(data, starts, ends, BYTE_VALUES)
        numbers = self.known.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, first, where = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at, raw = missing[first], data.tobytes()
            learned = self._learn([raw[i:j].decode() for i, j in zip(starts[at].tolist(), ends[at].tolist())])
            self.known.add(new, learned)
            numbers[missing] = learned[where]
        counts = self.counts[:, numbers]
        text_of = lambda at: (np.searchsorted(bounds, at, "right") - 1).tolist()
        whole.update(text_of(np.flatnonzero(counts[0] == -1)))
        none = set(text_of(np.flatnonzero(counts[0] == -2)))
        sums = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(np.maximum(counts, 0), 1)], 1)[:, bounds]
        (n_a, n_b, n_groups, n_links), cuts = np.diff(sums, axis=1).tolist(), sums[3].tolist()
        keys, shown = self.links.at(numbers), self.shown
        out = []
        for k, text in enumerate(texts):
            if text and k in whole:
                out.append(self._whole(text))
            elif not text or k in none:
                out.append((0, 0, 0, _EMPTY, b""))
            else:
                said = b";".join(map(shown.__getitem__, numbers[bounds[k] : bounds[k + 1]].tolist()))
                out.append((n_a[k], n_b[k], n_groups[k], keys[cuts[k] : cuts[k + 1]], said))
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner of two files, kept from task to task."""
    return held(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


def align_documents(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """doc_id, row, n_a, n_b, n_groups, n_links, groups (ids of either side by group), pairs and times of each row of `docs`.

    With `digest`, groups holds the sha256 of that text in hex instead, and nothing where there are no tokens.

    `pairs` holds a row's distinct linked id pairs as little-endian 32-bit keys a * size of b +
    b, ascending, `times` how many links each has. A text that is null or empty, or that either
    tokenizer does not spell byte for byte behind a space, has no tokens. Every row is aligned
    for itself, also those without doc_id or that repeat others.
    """
    row = free_name(docs, "row")
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias(row))

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = aligner(path_a, path_b)
        for b in batches:
            texts = b["text"].tolist()
            for i, j in batches_of(texts):
                rows = []
                for n_a, n_b, n_groups, keys, shown in known.align(texts[i:j]):
                    pairs, times = np.unique(keys, return_counts=True)
                    said = shown.decode() if not digest else hashlib.sha256(shown).hexdigest() if n_a else ""
                    rows.append((n_a, n_b, n_groups, len(keys), said, pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
                out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
                out.insert(0, "row", b[row].to_numpy()[i:j])
                out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)[i:j])
                yield out

    return in_batches(numbered, aligned, "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no pair of its a-id has more); see `align_documents` for the keys of pairs."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            new = np.frombuffer(b"".join(b["pairs"]), "<u4").astype(np.int64)
            mine, n = np.unique(new, return_counts=True)
            both, where = np.unique(np.concatenate([pairs, mine]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([sums, n]), len(both)).astype(np.int64)
            pairs = both
            if len(pairs) > PAIRS_AT_ONCE:
                yield pd.DataFrame({"pair": pairs, "n": sums})
                pairs, sums = pairs[:0], sums[:0]
        if len(pairs):
            yield pd.DataFrame({"pair": pairs, "n": sums})

    return in_batches(aligned.select("pairs"), counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_counts(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int | None = None) -> DataFrame:
    """Each row's alignment with corpus-wide counts: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of rows of `docs` that hold it linked. n_best counts the links
    whose count is the highest of their a-id, count_sum sums the counts over all links. A row
    without tokens has zeros and an empty groups_sha256. A table without rows gives none.
    """
    spark = docs.sparkSession
    measures = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = written(align_documents(docs, path_a, path_b, digest=True).withColumnRenamed("groups", "groups_sha256"), "aligned")
    size_b = aligner_size(path_b)
    counts = written(pair_counts(rows).withColumn("a", F.floor(F.col("pair") / size_b)), "pairs")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    counts = counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    if counts.count() <= (BROADCAST_PAIRS if broadcast_pairs is None else broadcast_pairs):
        found = counts.toPandas().sort_values("pair")
        sent = spark.sparkContext.broadcast((found["pair"].to_numpy("<u4"), found["n"].to_numpy(np.int64), found["best"].to_numpy(bool)))

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pairs, n, best = sent.value
            for b in batches:
                sums = []
                for p, t in zip(b["pairs"], b["times"]):
                    at, times = np.searchsorted(pairs, np.frombuffer(p, "<u4")), np.frombuffer(t, "<u4").astype(np.int64)
                    sums.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
                yield b.drop(columns=["pairs", "times"]).assign(n_best=[x for x, _ in sums], count_sum=[x for _, x in sums])

        kinds = dict(rows.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in measures)
        return in_batches(rows.select(*measures, "pairs", "times"), summed, f"{schema}, n_best long, count_sum long")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs, times = (np.frombuffer(b"".join(b[c]), "<u4").astype(np.int64) for c in ("pairs", "times"))
            yield pd.DataFrame({"row": np.repeat(b["row"].to_numpy(), b["pairs"].map(len) // 4), "pair": pairs, "times": times})

    counts = written(counts, "pairs")
    links = in_batches(rows.select("row", "pairs", "times"), spread, "row long, pair long, times long", rows=200)
    hot = F.col("n") * HOT_SHARE >= rows.count()
    often = links.join(F.broadcast(counts.filter(hot)), "pair")
    seldom = links.join(F.broadcast(counts.filter(hot).select("pair")), "pair", "left_anti").join(counts.filter(~hot), "pair")
    value = often.unionByName(seldom).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.join(value, "row", "left").select(*measures, zero("n_best"), zero("count_sum"))


def aligner_size(path_b: str) -> int:
    """Ids of the second vocabulary, which the pair keys count in."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
