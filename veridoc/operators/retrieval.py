"""Postings, BM25, phrase and vector search, rank fusion and gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import kept

K1, B, FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def bm25(docs: DataFrame, terms: list[str], k: int | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, rank of the documents with any of `terms` and all of `required`, best first, ties by doc_id.

    One pass counts documents, mean length and document frequencies; a second scores. No
    posting is shuffled, as the terms are few and known.
    """
    base = docs.select("doc_id", tokens(F.col("text")).alias("toks"))
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("toks")).alias("avgdl"), *[F.count_if(F.array_contains("toks", t)).alias(f"df{i}") for i, t in enumerate(terms)])
    scored = base.crossJoin(F.broadcast(stats)).withColumn("dl", F.size("toks"))
    total = F.lit(0.0)
    for i, t in enumerate(terms):
        tf = _times("toks", t).cast("double")
        idf = F.greatest(F.lit(FLOOR), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)))
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hit = F.arrays_overlap("toks", F.array(*map(F.lit, terms)))
    for t in required:
        hit = hit & F.array_contains("toks", t)
    found = scored.filter(hit).select("doc_id", F.round(total, 6).alias("score"))
    if k is None:
        return found
    top = found.orderBy(F.desc("score"), "doc_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf and dl of every document."""
    base = docs.select("doc_id", tokens(F.col("text")).alias("toks")).withColumn("dl", F.size("toks"))
    return base.select("doc_id", "dl", F.explode("toks").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """term and df; counted once a document, so the counts combine before the shuffle."""
    once = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return once.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


#: Words up to so many letters meet on forms with letters left out, longer ones on a third that no edit touched.
SHORT = 12
#: Signs of a block of words that are hashed at once; bits a key of an asked word, and the fewest and most bits (by power of two) in all.
LETTERS_AT_ONCE, BITS_A_KEY, LEAST_BITS, MOST_BITS = 1 << 20, 16, 20, 28
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, each spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """The powers of `base` from 0 to n, modulo 2 to the 64th."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _form_keys(sums: np.ndarray, n: int) -> list[np.ndarray]:
    """Hashes of words of n letters with none, one and two letters left out; `sums` are those of their first letters."""
    once, twice, end = np.uint64(_INVERSE), np.uint64(_INVERSE * _INVERSE % (1 << 64)), sums[:, n:]
    i, j = np.triu_indices(n, 1)
    one = sums[:, :n] + once * (end - sums[:, 1:])
    two = sums[:, i] + once * (sums[:, j] - sums[:, i + 1]) + twice * (end - sums[:, j + 1])
    return [end, one, two]


def _part_keys(sums: np.ndarray, n: int, lengths: range, shifts: range) -> list[np.ndarray]:
    """Hashes of what stands in words of n letters where the thirds of a word of each of `lengths` stand, moved by `shifts`."""
    back, out = _powers(_INVERSE, n), []
    for m in lengths:
        for i in range(3):
            first, last = m * i // 3, m * (i + 1) // 3
            for s in shifts:
                if m > SHORT and first + s >= 0 and last + s <= n:
                    part = (sums[:, last + s] - sums[:, first + s]) * back[first + s]
                    out.append(_mixed(part + np.uint64(3 * m + i + 1))[:, None])
    return out


def _word_keys(words: pa.Array, asked: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words and, row by row, the hashes of all on which they meet others; an asked word and a term within two edits share one."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for n in map(int, np.unique(sizes)):
        alike = np.nonzero(sizes == n)[0]
        for at in np.array_split(alike, -(-len(alike) * n // LETTERS_AT_ONCE)):
            codes = np.frombuffer("".join(words.take(pa.array(at)).to_pylist()).encode("utf-32-le"), np.uint32).reshape(len(at), n)
            sums = np.zeros((len(at), n + 1), np.uint64)
            np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(_BASE)) * _powers(_BASE, n)[:n], axis=1, out=sums[:, 1:])
            keys = _form_keys(sums, n) if n <= (SHORT if asked else SHORT + 2) else []
            if n > (SHORT if asked else SHORT - 2):
                keys += _part_keys(sums, n, range(n, n + 1) if asked else range(n - 2, n + 3), range(1) if asked else range(-2, 3))
            yield at, _mixed(np.concatenate(keys, axis=1))


def _asked_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, keys in _word_keys(batch.column(0), True):
            yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(at, keys.shape[1]))), pa.array(keys.ravel().view(np.int64))], ["word", "key"])


def _key_bits(keys: DataFrame) -> tuple[int, np.ndarray]:
    """A number of bits, a power of two told by its exponent, and these: those of the first bits of a key of `keys` are set."""
    n = min(max((BITS_A_KEY * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)
    at = F.shiftrightunsigned("key", 64 - n)
    parts = keys.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits"))
    bits = np.zeros((1 << n - 15, 4096), np.uint8)
    for part, some in parts.toLocalIterator():
        bits[part] = np.frombuffer(some, np.uint8)
    return n, bits.ravel()


def suggestions(asked: DataFrame, known: DataFrame) -> DataFrame:
    """word, suggestion, edits: for each `word` of `asked` that is not in `known` (term, df), the nearest term within two edits, of equals the one in most documents.

    Two words within two edits share a form with up to two letters left out of either, on which
    short words meet. Of a long word's three parts two edits leave one as it was, at most two
    letters from its place, so long words meet on a part, its number and the asked word's
    length; that makes 75 parts of a term, however long it is. They meet on hashes, and every
    pair is compared whole. A bitmap of the asked words' hashes (32 MB at most) goes to the terms,
    so a hash that no asked word has is not shuffled. Only terms whose length is
    within two letters of an asked word's are spelt out at all. Words of fewer than four
    letters, and any with a sign or digit, are neither corrected nor suggested. A word without
    a term near has no row.
    """
    letters = r"^\p{L}{4,}$"
    known, asked = known.filter(F.col("term").rlike(letters)), asked.filter(F.col("word").rlike(letters))
    missing = kept(asked.select("word").join(known, asked["word"] == known["term"], "left_anti"), "missing")
    lengths = missing.select(F.char_length("word").alias("n")).distinct().select(F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2)).alias("m")).distinct()
    a = kept(missing.mapInArrow(_asked_keys, "word string, key long"), "keys")
    n_bits, bits = _key_bits(a)
    sent = known.sparkSession.sparkContext.broadcast(bits)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, keys in _word_keys(batch.column(0), False):
                place = keys >> np.uint64(64 - n_bits)
                hit = (sent.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
                row, column = np.nonzero(hit)
                of = pa.array(at[row])
                yield pa.record_batch([batch.column(0).take(of), batch.column(1).take(of), pa.array(keys[row, column].view(np.int64))], ["term", "df", "key"])

    terms = known.withColumn("m", F.char_length("term")).join(lengths, "m", "left_semi").select("term", F.col("df").cast("long").alias("df"))
    near = a.join(terms.mapInArrow(held, "term string, df long, key long"), "key").select("word", "term", "df").distinct()
    near = near.withColumn("edits", F.levenshtein("word", "term", 2)).filter("edits >= 0")
    best = near.groupBy("word").agg(F.min(F.struct("edits", (-F.col("df")).alias("seldom"), "term")).alias("x"))
    return best.select("word", F.col("x.term").alias("suggestion"), F.col("x.edits").alias("edits"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def score_of(question: list[float]) -> Column:
    """The dot product of `embedding` with a question's vector, as it is ranked."""
    return F.round(dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in question])), 9)


def vector_topk(vectors: DataFrame, question: list[float], k: int) -> DataFrame:
    """vec_id, score, rank by exact dot product of unit vectors; filter `vectors` to the scope first."""
    top = vectors.select("vec_id", score_of(question).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))


#: Questions that are sent to the vectors at a time; vectors and questions that are multiplied at once.
QUESTIONS = 4096
VECTOR_BLOCK, QUESTION_BLOCK = 8192, 512


def _sized(rows: pa.ListScalar) -> dict[int | None, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors (float64) of a list of structs id and x, by the vectors' length; those without a vector under None."""
    ids, lists = (rows.values.field(i) for i in (0, 1))
    ids, sizes = ids.to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes):
        at = np.nonzero(sizes == n)[0]
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64) if n >= 0 else np.zeros(0)
        out[None if n < 0 else int(n)] = ids[at], flat.reshape(len(at), max(int(n), 0))
    return out


def _kth(groups: list[np.ndarray], k: int) -> np.ndarray:
    """Which rows are among the first k of those that are alike in `groups`, in the order given by the last sort key, groups[0]."""
    order = np.lexsort(groups)
    alike = np.zeros(len(order), bool)
    alike[1:] = np.logical_and.reduce([g[order][1:] == g[order][:-1] for g in groups[1:]])
    place = np.arange(len(order))
    keep = np.zeros(len(order), bool)
    keep[order] = place - np.maximum.accumulate(np.where(alike, 0, place)) < k
    return keep


def _best(qs: tuple[np.ndarray, np.ndarray], vs: tuple[np.ndarray, np.ndarray], k: int, itself: bool, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of questions, vec_ids and scores: all that can be among the k best of these vectors, scores within `slack` being alike.

    One product of matrices tells which come near the k-th best. Those are scored anew, summed in order of the dimensions as
    `dot` sums, so a score has the same bits wherever it is made. Of vectors that are equal k + 1 stand for all.
    """
    (q_ids, q), (ids, v) = qs, vs
    with np.errstate(all="ignore"):
        same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)[1].ravel() if v.shape[1] else np.zeros(len(v), int)
        kept = _kth([ids, same], k + 1)
        ids, v = ids[kept], v[kept]
        near = q @ v.T
        near[np.isnan(near)] = np.inf
        if not itself:
            near[q_ids[:, None] == ids[None, :]] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(q), -np.inf)
        size = lambda x: (s := np.sqrt((x * x).sum(axis=1)))[np.isfinite(s)].max(initial=0.0)
        error = 1e-15 * (v.shape[1] + 1) * size(q) * size(v)
        mask = near >= (least - 2 * (error + slack))[:, None]
        if not itself:
            mask &= q_ids[:, None] != ids[None, :]
        a, b = np.nonzero(mask)
        score = np.empty(len(a))
        columns = q.T.copy(), v.T.copy()
        for i in range(0, len(a), 1 << 16):
            at, total = slice(i, i + (1 << 16)), 0.0
            for x, y in zip(*columns):
                total = total + x[a[at]] * y[b[at]]
            score[at] = total
    # of equal scores of a question the first k can count; nan is one score
    first = _kth([ids[b], np.nan_to_num(score, nan=np.inf, posinf=np.inf, neginf=-np.inf), np.isnan(score), a], k)
    return a[first], ids[b][first], score[first]


def nearest(vectors: DataFrame, questions: DataFrame, k: int, itself: bool = True, digits: int | None = None, block: int = QUESTIONS) -> DataFrame:
    """The k best of `vectors` for each question by exact dot product, ties by vec_id: q_id, vec_id, rank.

    `questions` has q_id and asked (a vector). They are counted and sent in blocks of about `block`, so what a task holds doesn't
    grow with them. Vectors meet questions in blocks, each a product of two matrices; a block of vectors passes on only what can
    be among its own k best a question, with exact scores. `itself` tells whether a vector may answer the question of its own
    number; scores are rounded to `digits` where given. Null vectors, and vectors of another length than the question's, rank last.
    """
    whole = lambda c: F.when(F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull()), F.col(c)).alias("x")
    dealt = lambda rows, key, vector, n, name: rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("part")).agg(F.collect_list(F.struct(F.col(key), whole(vector))).alias(name)).select(name)
    n_asked, n_held = questions.count(), vectors.count()
    blocks = max(1, -(-n_asked // block))
    held = dealt(vectors, "vec_id", "embedding", max(1, -(-n_held // VECTOR_BLOCK)), "vs")
    slack = 0.0 if digits is None else 10.0**-digits

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qs, vs in zip(batch.column("qs"), batch.column("vs")):
                asked, sized = _sized(qs), _sized(vs)
                for n, (q_ids, q) in asked.items():
                    unlike = [ids for m, (ids, _) in sized.items() if m != n or n is None]
                    for ids in [np.sort(np.concatenate(unlike))[: k + 1]] if unlike else []:
                        a, b = np.nonzero((q_ids[:, None] != ids[None, :]) | itself)
                        yield pa.record_batch([pa.array(q_ids[a], pa.int64()), pa.array(ids[b], pa.int64()), pa.nulls(len(a), pa.float64())], ["q_id", "vec_id", "score"])
                    if n is not None and n in sized:
                        a, ids, score = _best((q_ids, q), sized[n], k, itself, slack)
                        yield pa.record_batch([pa.array(q_ids[a], pa.int64()), pa.array(ids, pa.int64()), pa.array(score)], ["q_id", "vec_id", "score"])

    found = None
    for b in range(blocks):
        asked = questions if blocks == 1 else questions.filter(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b)
        asked = dealt(asked.select("q_id", "asked"), "q_id", "asked", max(1, -(-min(n_asked, block) // QUESTION_BLOCK)), "qs")
        pairs = held.crossJoin(F.broadcast(asked)).mapInArrow(met, "q_id long, vec_id long, score double")
        score = F.col("score") if digits is None else F.round("score", digits)
        rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id"))
        best = pairs.select("q_id", "vec_id", score.alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k).select("q_id", "vec_id", "rank")
        found = best if found is None else found.unionByName(best)
    return found


def rrf(lists: list[tuple[DataFrame, str]], k: int = RRF_K) -> DataFrame:
    """id and fused score of ranked lists (id, rank); a list without an id adds nothing."""
    out = None
    for df, name in lists:
        one = df.select("id", F.col("rank").alias(name))
        out = one if out is None else out.join(one, "id", "full_outer")
    total = F.lit(0.0)
    for _, name in lists:
        total = total + F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(name)), F.lit(0.0))
    return out.withColumn("fused", F.round(total, 9))


def separation(df: DataFrame, score: str) -> DataFrame:
    """How far below the top a score is, in units of the distance from the top to the median."""
    stats = df.agg(F.max(score).alias("_top"), F.expr(f"percentile({score}, 0.5)").alias("_mid"))
    gap = (F.col("_top") - F.col(score)) / F.greatest(F.col("_top") - F.col("_mid"), F.lit(1e-9))
    return df.crossJoin(F.broadcast(stats)).withColumn("separation", F.round(gap, 6)).drop("_top", "_mid")
