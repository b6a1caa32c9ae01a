"""Near-duplicate components by a chosen-path set similarity join.

Each of several independent trees starts by dealing the documents out by one minwise token
of their shingle sets. A node with many documents branches again, by BRANCHES tokens that
the node's own name selects; a small node is compared exhaustively. Enough trees are grown
for a pair at the threshold to meet with the probability RECALL. Documents meet as minwise
signatures; what these can't rule out is confirmed on full shingle sets.

A large node whose rows mostly stay together when it branches is a group of near copies, which
more branching would only multiply; it is compared block by block instead.

Documents with equal sets are one class from the start, and only its smallest doc_id enters
the trees, so copies cost nothing. Within a node, pairs that the signatures put far above
the threshold are confirmed along a spanning forest alone: as long as its links hold, the pairs
it leaves out could not change a component. Where one fails, its node is compared once more and all
pairs between what is not connected by then are confirmed, so the forest loses nothing. Candidates leave a node as one row per block of its documents, the likeliest
first, and pairs that are connected already are not confirmed. A pair that meets in several trees
counts in the first one only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, let_go, written
from .components import connected_components
from .shingles import mix, shingle_set

#: Signature positions, and standard deviations above the threshold at which a pair is sure.
POSITIONS, ABOVE = 192, 4.5
#: Of a pair at the threshold; trees and signatures may each miss half of the rest.
RECALL, BRANCHES = 0.999999, 2
#: Documents of a node that is compared exhaustively, levels of branching above that, and the share of a node in one child that makes it tight.
SMALL, DEPTH, TIGHT = 4096, 24, 0.5
#: Groups over which copies are spread; documents of a node whose sets travel together, and shingles of those.
SALTS, BLOCK, BLOCK_SHINGLES = 16, 512, 1_000_000
#: Candidates' ids (a long each) up to which they are broadcast, so that the texts are not shuffled to them.
BROADCAST_IDS = 1_000_000
_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 1 << 32, POSITIONS, np.uint64) | 1).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, POSITIONS, np.uint64).astype(np.uint32)


def trees_for(threshold: float, recall: float = RECALL) -> int:
    """Trees with which a pair at the threshold is met with probability `recall`.

    A tree keeps the pair at its first token with probability `threshold`, and below it with
    the probability s of never dying out, where s = 1 - (1 - threshold * s) ** BRANCHES.
    """
    s = 1.0
    for _ in range(200):
        s = 1 - (1 - threshold * s) ** BRANCHES
    return min(POSITIONS, max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold * s))))


def least_agreeing(threshold: float, miss: float) -> int:
    """The most positions to ask for so that a pair at the threshold agrees in fewer with a probability of at most `miss`."""
    below = 0.0
    for k in range(POSITIONS + 1):
        below += math.comb(POSITIONS, k) * threshold**k * (1 - threshold) ** (POSITIONS - k)
        if below > miss:
            return k
    return POSITIONS


def signature(shingles: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """16-bit minwise values at each position, and the first node of each tree."""
    low = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    first = np.zeros(trees, np.uint64)
    words = (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(words), 1 << 15):
            part = words[at : at + (1 << 15)]
            values = part[None, :] * _MUL[:, None] + _ADD[:, None]
            best = values[:trees].argmin(1)
            least = values.min(1)
            better = least[:trees] < low[:trees] if at else np.ones(trees, bool)
            first[better] = shingles[at + best[better]]
            low = np.minimum(low, least)
        return (mix(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16), mix(first * np.uint64(2) + mix(np.arange(trees, dtype=np.uint64)))


def _compare(g: pd.DataFrame, limit: float, low: int, high: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of a node's rows worth confirming, the likeliest first, and how many of them are a forest's.

    These are the pairs that may reach `limit`, thinned to a forest among the sure ones. With a
    column component there is no forest: all pairs of different components count. Left out are pairs that an earlier tree compares: those with the same first node there, if it was small.
    Rows of the sides 0 and 1 are compared across alone.
    """
    n, tree = len(g), g["tree"].iat[0]
    sigs = np.ascontiguousarray(np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(n, -1).T)
    nodes, small = np.stack(g["nodes"].to_list()).T[:tree], g["small"].to_numpy()
    sizes, side = g["n_shingles"].to_numpy(np.float32), g["side"].to_numpy()
    may, sure = np.zeros((n, n), bool), np.zeros((n, n), bool)
    for at in range(0, n, 256):
        part = slice(at, at + 256)
        same = np.zeros((len(sizes[part]), n), np.int16)
        for row in sigs:
            same += row[part, None] == row[None, :]
        here = (same >= low) & (np.minimum(sizes[part, None], sizes[None, :]) >= limit * np.maximum(sizes[part, None], sizes[None, :]) - 1e-3)
        if (side < 2).any():
            here &= side[part, None] != side[None, :]
        if here.any():
            for t, row in enumerate(nodes):
                here &= (row[part, None] != row[None, :]) | ((small[part] >> t) & 1 == 0)[:, None]
            may[part], sure[part] = here, here & (same >= high)
    np.fill_diagonal(may, False)
    np.fill_diagonal(sure, False)
    again = "component" in g
    label, left, right = np.unique(g["component"], return_inverse=True)[1] if again else np.full(n, -1), [], []
    for root in [] if again else np.flatnonzero(sure.any(1)).tolist():
        if label[root] >= 0:
            continue
        label[root], line = root, [root]
        while line:
            u = line.pop()
            new = np.flatnonzero(sure[u] & (label < 0))
            label[new] = root
            line += new.tolist()
            left.append(np.full(len(new), u))
            right.append(new)
    forest = sum(map(len, left))
    alone = label < 0
    label[alone] = np.flatnonzero(alone)
    for at in range(0, n, 256):
        a, b = np.nonzero(may[at : at + 256] & (label[at : at + 256, None] != label[None, :]))
        up = a + at < b
        left.append(a[up] + at)
        right.append(b[up])
    left, right = np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64)
    agree = np.concatenate([(sigs[:, left[i : i + 4096]] == sigs[:, right[i : i + 4096]]).sum(0) for i in range(0, len(left), 4096)] or [left])
    likely = np.argsort(-agree, kind="stable")  # the forest's agree in `high` places or more, no other does
    return left[likely], right[likely], forest


def _blocks(g: pd.DataFrame, left: np.ndarray, right: np.ndarray, forest: int) -> Iterator[tuple[int, int, int, list[int], bytes]]:
    """(block, node, forest, ids, pairs) of a node's candidates: at most two blocks' documents, and places among them, two an int32 pair; the first `forest` are a forest's."""
    ids, sizes = g["rep"].to_numpy(), g["n_shingles"].to_numpy(np.int64)
    block = np.maximum.accumulate(np.maximum(np.arange(len(g)) // BLOCK, np.cumsum(sizes) // BLOCK_SHINGLES))
    both = np.minimum(block[left], block[right]) * (int(block[-1]) + 1) + np.maximum(block[left], block[right])
    with np.errstate(over="ignore"):
        keys = mix(np.uint64(int(g["node"].iat[0]) & ((1 << 63) - 1)) + both.astype(np.uint64)).view(np.int64)
    for b in np.unique(both).tolist():
        at = np.flatnonzero(both == b)
        members, where = np.unique(np.concatenate([left[at], right[at]]), return_inverse=True)
        yield int(keys[at[0]]), int(g["node"].iat[0]), int((at < forest).sum()), ids[members].tolist(), where.reshape(2, -1).T.astype("<i4").tobytes()


def groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The runs of equal `key` of a sorted partition, each whole."""
    held: list[pd.DataFrame] = []
    for b in batches:
        values = b[key].to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(b)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and held[0][key].iat[0] != values[i]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(b.iloc[i:j])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits and the size of a shingle set: equal for equal sets."""
    with np.errstate(over="ignore"):
        return np.array([shingles.sum(dtype=np.uint64), mix(shingles).sum(dtype=np.uint64), len(shingles)], np.uint64).tobytes()


def shingled(docs: DataFrame, words: int, trees: int) -> DataFrame:
    """doc_id, n_shingles, set_key, sig and nodes of every document with an id."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].tolist(), b["text"].tolist()):
                s = shingle_set(text, words)
                if not len(s):
                    out.append((doc_id, 0, None, None, None))
                    continue
                key = set_key(s)
                sig, nodes = signature(s, trees)
                out.append((doc_id, len(s), key, sig.tobytes(), nodes.view(np.int64).tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_key", "sig", "nodes"])

    return in_batches(docs.filter("doc_id is not null").select("doc_id", "text"), rows, "doc_id long, n_shingles long, set_key binary, sig binary, nodes array<long>")


_ROW = "rep long, n_shingles long, sig binary, nodes array<long>, small int, tree int, side int, node long"
_NAMES = [f.split()[0] for f in _ROW.split(", ")]


def _large_nodes(rows: DataFrame) -> DataFrame:
    """Branches the nodes of more than SMALL documents, and returns the rows of all the smaller ones that this makes.

    A node that keeps more than TIGHT of its rows in one child, or is left after DEPTH levels,
    is cut into blocks that are compared two by two; so a level at most keeps the rows there were.
    """

    def branched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sigs = np.frombuffer(b"".join(b["sig"]), np.uint16).reshape(len(b), -1)
            node = b["node"].to_numpy(np.int64).view(np.uint64)
            for k in range(BRANCHES):
                with np.errstate(over="ignore"):  # another position for each branch
                    step = mix(node * np.uint64(5) + np.uint64(1)) % np.uint64(POSITIONS - 1) + np.uint64(1)
                    at = ((mix(node * np.uint64(5)) % np.uint64(POSITIONS) + np.uint64(k) * step) % np.uint64(POSITIONS)).astype(np.int64)
                    child = mix(node * np.uint64(7) + at.astype(np.uint64)) ^ mix(sigs[np.arange(len(b)), at].astype(np.uint64) + np.uint64(1))
                yield b.assign(parent=b["node"], node=mix(child).view(np.int64))

    def in_blocks(large: DataFrame) -> DataFrame:
        blocks = F.ceil(F.col("n") / (SMALL // 2)).cast("int")
        mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
        with_all = large.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        pair = F.xxhash64("node", F.least("_mine", "_other"), F.greatest("_mine", "_other"))
        side = F.when(F.col("_mine") == F.col("_other"), 2).when(F.col("_mine") < F.col("_other"), 0).otherwise(1)
        return with_all.withColumn("side", side.cast("int")).withColumn("node", pair).select(_NAMES)

    done = []
    rows = rows.select(*_NAMES, "n")
    for level in range(DEPTH + 1):
        if level == DEPTH:
            done.append(in_blocks(rows))
            break
        children = written(in_batches(rows.select(_NAMES), branched, _ROW + ", parent long"), "branches")
        counts = written(children.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("n")), "branch-counts")
        tight = counts.groupBy("parent").agg(F.max("n").alias("most"), F.sum("n").alias("all")).filter(F.col("most") > TIGHT / BRANCHES * F.col("all"))
        tight = written(tight.select("parent"), "tight")
        done.append(in_blocks(rows.join(tight, rows["node"] == tight["parent"], "left_semi")))
        loose = counts.filter("n > 1").join(tight, "parent", "left_anti").select("node", "n")
        rows = written(children.drop("parent").join(loose, "node"), "nodes")
        done.append(rows.filter(f"n <= {SMALL}").select(_NAMES))
        rows = rows.filter(f"n > {SMALL}").select(*_NAMES, "n")
        if rows.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


_BLOCK = "block long, node long, forest int, ids array<long>, pairs binary"


def dealt_rows(reps: DataFrame) -> DataFrame:
    """A row of every representative for each node in which it is compared."""
    nodes = reps.select("rep", F.posexplode("nodes").alias("tree", "node"))
    counts = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = written(nodes.join(counts, "node").groupBy("rep").agg(F.collect_list(F.struct("tree", "node", "n")).alias("at")), "met")
    small = F.aggregate("at", F.lit(0), lambda acc, x: acc + F.when(x["n"] <= SMALL, F.call_function("shiftleft", F.lit(1), x["tree"])).otherwise(0))
    rows = reps.join(met, "rep").withColumn("small", small)

    def placed(test) -> DataFrame:
        """A row for each of a document's nodes that `test` takes."""
        each = rows.select("rep", "n_shingles", "sig", "nodes", "small", F.explode(F.filter("at", test)).alias("x"))
        return each.select("rep", "n_shingles", "sig", "nodes", "small", "x.tree", F.lit(2).alias("side"), "x.node", "x.n")

    dealt = placed(lambda x: x["n"] <= SMALL).select(_NAMES)
    if not met.filter(F.exists("at", lambda x: x["n"] > SMALL)).isEmpty():
        dealt = dealt.unionByName(_large_nodes(written(placed(lambda x: x["n"] > SMALL), "large")))
    return dealt


def candidate_blocks(dealt: DataFrame, threshold: float) -> DataFrame:
    """(block, node, forest, ids, pairs) of what some tree brought together and the signatures don't put below the threshold.

    A block is a part of one node with at most 2 * BLOCK documents, `ids`; `pairs` are places among them.
    """
    spread = math.sqrt(threshold * (1 - threshold) / POSITIONS)
    low, high = least_agreeing(threshold, (1 - RECALL) / 2), math.ceil(min(1.0, threshold + ABOVE * spread) * POSITIONS)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for g in groups(batches, "node"):
            left, right, forest = _compare(g, threshold, low, high)
            if len(left):
                yield pd.DataFrame(list(_blocks(g, left, right, forest)), columns=["block", "node", "forest", "ids", "pairs"])

    return in_batches(dealt.repartition("node").sortWithinPartitions("node"), compared, _BLOCK)


def candidate_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of every pair of `candidate_blocks`."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, raw in zip(b["ids"], b["pairs"]):
                yield pd.DataFrame(ids[np.frombuffer(raw, "<i4").reshape(-1, 2)], columns=["a", "b"])

    return in_batches(candidate_blocks(dealt_rows(reps), threshold), pairs, "a long, b long")


def confirmed(blocks: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b, linked) among the blocks' pairs, 100 * intersection >= percent * union of full shingle sets, enough to connect all that are linked.

    A forest's pair that is no link comes too, not linked, with its node. A block's sets travel to its pairs once, however many pairs share them. Of the texts of
    one doc_id that with the least set counts.
    """

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for b in batches:
            made = [shingle_set(t, words) for t in b["text"].tolist()]
            short = [(s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in made]
            yield pd.DataFrame({"id": b["doc_id"], "set_key": list(map(set_key, made)), "shingles": short})

    def opened(raw: bytes) -> np.ndarray:
        wide = np.zeros((len(raw) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        return wide.reshape(-1).view("<u8")

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, "block"):
            ids = g["id"].tolist()
            full = {i: opened(raw) for i, raw in zip(ids, g["shingles"]) if raw is not None}
            found = []
            for names, pairs, forest, node in zip(g["ids"], g["pairs"], g["forest"], g["node"]):
                if names is None:
                    continue
                own, root = [full[i] for i in names.tolist()], list(range(len(names)))
                for k, (i, j) in enumerate(np.frombuffer(pairs, "<i4").reshape(-1, 2).tolist()):
                    a, b = i, j
                    while root[a] != a:
                        root[a] = a = root[root[a]]
                    while root[b] != b:
                        root[b] = b = root[root[b]]
                    if a == b:
                        continue
                    x, y = own[i], own[j]
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    both = int(np.count_nonzero(x[at] == y))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        root[b] = a
                        found.append((names[i], names[j], True, node))
                    elif k < forest:
                        found.append((names[i], names[j], False, node))
            if found:
                yield pd.DataFrame(found, columns=["a", "b", "linked", "node"])

    members = blocks.select("block", F.explode("ids").alias("id"))
    ids = written(members.select(F.col("id").alias("doc_id")).distinct(), "candidates")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    full = in_batches(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), sets, "id long, set_key binary, shingles binary")
    full = full.groupBy("id").agg(F.min_by("shingles", "set_key").alias("shingles"))
    none = F.lit(None)
    rows = members.join(full, "id").select("block", "id", "shingles", none.cast("array<bigint>").alias("ids"), none.cast("binary").alias("pairs"), F.lit(0).alias("forest"), F.lit(0).cast("long").alias("node"))
    rows = rows.unionByName(blocks.select("block", none.cast("long").alias("id"), none.cast("binary").alias("shingles"), "ids", "pairs", "forest", "node"))
    return in_batches(rows.repartition("block").sortWithinPartitions("block"), checked, "a long, b long, linked boolean, node long")


def links_of(reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all representatives that are linked; nodes in which a forest's pair failed are compared again."""
    dealt = dealt_rows(reps)
    first = written(confirmed(written(candidate_blocks(dealt, percent / 100), "blocks"), docs, words, percent), "links")
    links, failed = first.filter("linked").select("a", "b"), first.filter("not linked").select("node").distinct()
    if failed.isEmpty():
        return links
    of = connected_components(links).select(F.col("node").alias("rep"), "component")
    rows = dealt.join(failed, "node", "left_semi").join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    blocks = written(candidate_blocks(rows, percent / 100), "blocks")
    return links.unionByName(written(confirmed(blocks, docs, words, percent), "links").filter("linked").select("a", "b"))


def near_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per doc_id: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (doc_id is that).

    Documents are linked when 100 * intersection >= percent * union of their sets of
    `words`-word shingles (words: runs of other than ASCII white space, A-Z lower-cased; a
    shorter document is one shingle). A null text, or one without words, is linked with
    nothing. Rows without doc_id are left out; rows that repeat a doc_id are one document,
    with the text of the least set key (a text without words comes first). doc_ids are expected
    from 0 up. A table without rows gives none; other columns are not read.
    """
    trees = trees_for(percent / 100, (1 + RECALL) / 2)
    sets = written(shingled(docs, words, trees), "shingled")
    if not sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        one = F.min_by(F.struct("n_shingles", "set_key", "sig", "nodes"), F.coalesce("set_key", F.lit(b""))).alias("x")
        sets = written(sets.groupBy("doc_id").agg(one).select("doc_id", "x.*"), "shingled")
    classes = sets.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    classes = classes.select("set_key", "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    classed = salted.join(classes, ["set_key", "salt"], "left").withColumn("rep", F.coalesce("low", "doc_id"))
    classed = written(classed.select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig"), F.when(F.col("doc_id") == F.col("rep"), F.col("nodes")).alias("nodes")), "classed")
    reps = classed.filter("sig is not null").select("rep", "n_shingles", "sig", "nodes")
    found = connected_components(links_of(reps, docs, words, percent))
    out = classed.join(found, classed["rep"] == found["node"], "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
