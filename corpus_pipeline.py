"""The corpus pipeline: stages over documents, each on all that the one before it kept.

Every stage but the last returns the columns of documents; the last packs the ids of what
remains. n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm import chosen_path, decontaminate, packing, site_lines, toxicity
from veridoc.llm.common import free_name, table, written

#: A document is rejected as toxic from this score on.
TOXIC_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC_SCORE, by a model fitted on the labelled ones; a null or empty text is scored as one without words."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, toxicity.held_out(F.col("doc_id"), 5))
    score = free_name(docs, "_score")
    return toxicity.score(docs, model, score).filter(F.col(score) < TOXIC_SCORE).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that are boilerplate of its source; exact copies count as one page there."""
    counts = free_name(docs, "_kept"), free_name(docs, "_all")
    out = site_lines.drop_site_lines(docs, "source", "text", copies_once=True, counts=counts).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies (five words, 0.8), and all without an id."""
    found = written(chosen_path.near_components(docs, words=5, percent=80).filter("not kept").select("doc_id"), "copies")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window is like a benchmark item; those without text or id stay."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents' ids in sequences of 2048; a null text is one end id, an empty table has none."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The models, signatures and tokenizers of its stages are beyond SQL; tests hold each against brute force.
ORACLE_SQL = None
