"""Retrieval and answer quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS


def precision_recall(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """q_id, precision and recall at each k, and reciprocal rank of the first expected hit.

    hits: q_id, doc_id, rank; gold: q_id, doc_id. A question without hits has zeros.
    """
    wanted = gold.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_gold"))
    return measured(hits.join(gold.withColumn("good", F.lit(True)), ["q_id", "doc_id"], "left"), wanted, ks)


def measured(good: DataFrame, wanted: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """`precision_recall` of hits that are judged already (q_id, rank, good) and the number of each question's gold (q_id, n_gold)."""
    aggs = [F.count_if(F.col("good") & (F.col("rank") <= k)).alias(f"g{k}") for k in ks]
    per = good.groupBy("q_id").agg(*aggs, F.min(F.when(F.col("good"), F.col("rank"))).alias("first"))
    j = wanted.join(per, "q_id", "left")
    out = [F.round(F.coalesce(F.col(f"g{k}"), F.lit(0)) / k, 6).alias(f"precision_{k}") for k in ks]
    out += [F.round(F.coalesce(F.col(f"g{k}"), F.lit(0)) / F.col("n_gold"), 6).alias(f"recall_{k}") for k in ks]
    return j.select("q_id", *out, F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def overlap_support(answer: Column, evidence: Column) -> Column:
    """Share of the answer's words that the evidence has; null below three words."""
    words = F.array_distinct(answer)
    return F.when(F.size(words) >= 3, F.size(F.array_intersect(words, evidence)) / F.size(words))


#: A claim has so many content words; shares of them that make it supported, and a cited passage relevant.
CLAIM_WORDS, SUPPORT, RELEVANT = 3, 0.7, 0.4
MARK, FIGURE = r"\[([0-9]+)\]", r"[0-9][0-9.,]*[0-9]|[0-9]"


def _content(text: Column) -> Column:
    """The words of a text that say something, marks of citations left out."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), MARK, " ")
    return F.filter(F.regexp_extract_all(plain, F.lit(r"[\p{L}0-9]+"), F.lit(0)), lambda w: (F.char_length(w) > 1) & ~w.isin(*STOPWORDS))


def _figures(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), MARK, " "), F.lit(FIGURE), F.lit(0)))


def _share(words: Column, held: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.array_contains(held, w))) / F.size(words)


def answer_scores(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """a_id, n_claims, faithfulness, citation_recall, citation_precision and noise_sensitivity of every answer.

    `answers`: a_id and sentences (an array); `passages`: a_id, n (from 1), text and gold (whether
    it really answers the question); a mark [n] in a sentence cites the n-th. A sentence of
    CLAIM_WORDS content words is a claim. It is supported if SUPPORT of them and all of its
    figures are in the passages that it cites, or in any where it cites none. Recall is the
    share of claims that cite, precision the share of citations whose passage holds RELEVANT
    of the claim's words, noise the share of claims that cite no gold passage although they
    cite, or that the gold ones among these don't support. An answer without a claim has n 0
    and nulls, one without citations no precision. An answer's passages are in one row.
    """
    shown = passages.select("a_id", F.struct("n", _content(F.col("text")).alias("words"), _figures(F.col("text")).alias("figures"), "gold").alias("p"))
    pools = shown.groupBy("a_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    said = answers.select("a_id", F.explode("sentences").alias("sentence")).select("a_id", _content(F.col("sentence")).alias("words"), _figures(F.col("sentence")).alias("figures"), F.regexp_extract_all("sentence", F.lit(MARK), F.lit(1)).alias("marks"))
    none = F.array().cast("array<struct<n:int,words:array<string>,figures:array<string>,gold:boolean>>")
    claims = said.filter(F.size("words") >= CLAIM_WORDS).join(pools, "a_id", "left").withColumn("ps", F.coalesce("ps", none))
    cited = F.array_distinct(F.filter(F.transform("marks", lambda m: m.cast("int")), lambda m: F.exists("ps", lambda p: p["n"] == m)))
    claims = claims.withColumn("cited", cited)
    claims = claims.withColumn("pool", F.filter("ps", lambda p: (F.size("cited") == 0) | F.array_contains("cited", p["n"])))

    def supported(pool: Column) -> Column:
        words, figures = (F.flatten(F.transform(pool, lambda p: p[c])) for c in ("words", "figures"))
        return (_share(F.col("words"), words) >= SUPPORT) & (F.size(F.array_except("figures", figures)) == 0)

    gold = F.filter("pool", lambda p: p["gold"])
    relevant = F.size(F.filter("pool", lambda p: (F.size("cited") > 0) & (_share(F.col("words"), p["words"]) >= RELEVANT)))
    tested = claims.select("a_id", supported(F.col("pool")).alias("ok"), F.size("cited").alias("cites"), relevant.alias("relevant"), (~supported(gold) | ((F.size("cited") > 0) & (F.size(gold) == 0))).alias("noise"))
    n = F.count(F.lit(1))
    sums = tested.groupBy("a_id").agg(
        n.alias("n"), F.round(F.count_if("ok") / n, 6).alias("faithfulness"), F.round(F.count_if(F.col("cites") > 0) / n, 6).alias("citation_recall"),
        F.round(F.sum("relevant") / F.nullif(F.sum("cites"), F.lit(0)), 6).alias("citation_precision"), F.round(F.count_if("noise") / n, 6).alias("noise_sensitivity"),
    )
    out = answers.select("a_id").join(sums, "a_id", "left")
    return out.select("a_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_claims"), "faithfulness", "citation_recall", "citation_precision", "noise_sensitivity")
