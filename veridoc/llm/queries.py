"""The registered queries of the llm operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chosen_path, decontaminate, fingerprints, language_crf, packing, periodic_runs, quality, repair, site_lines, suffix_dedup, toxicity, warc
from .common import table


def op1_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written in shards under Re-Pair and read back: doc_id, start, n_tokens, ids_crc32, n_symbols.

    A null or empty text has its end id alone. Rows without doc_id come first; rows of one doc_id
    stand side by side, each for itself. No rows give none.
    """
    path = public_tokenizers.path("word_bpe_49k.json")
    shards = repair.write_ids(table(spark, sf_dir, "documents"), path, keeps_space=False, end_id=2, base=49408)
    return repair.read_ids(shards)


def op2_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a chain of labelled words: doc_id, held_out, lang_pred, score, n_words, switches.

    A null text, or one without letters, is und with score 0. Every row has its row; one without
    doc_id is not held out and is not learned from. Without labelled documents all are und.
    """
    docs = table(spark, sf_dir, "documents")
    model = language_crf.fit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return language_crf.label_documents(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_words", "switches")


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies by three-word shingles at 0.85: doc_id, n_shingles, component_id, kept; see `near_components` for nulls and repeats."""
    return chosen_path.near_components(table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Every row has its record; a null page_id stays null and is a
    response only where no other page has its payload. No rows give none.
    """
    read = warc.read_archives(warc.write_pages(table(spark, sf_dir, "pages"), min_bytes=0))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a window like a benchmark item, with the best window; see `find_leaks` for nulls, repeats and empty tables."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_site_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source: doc_id, n_lines, n_kept, text; see `drop_site_lines` for nulls and repeats."""
    out = site_lines.drop_site_lines(table(spark, sf_dir, "documents"), "source", "text")
    return out.select("doc_id", F.col("_all").cast("long").alias("n_lines"), F.col("_kept").cast("long").alias("n_kept"), "text")


def op7_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted.

    A null or empty text is scored as one without words. Every row has its row; one without doc_id
    is not held out. Without labelled toxic documents every score is near 0. No rows give none.
    """
    docs, held = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 5)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    predicted = (F.col("_score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), predicted)


def op8_log_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 400 bytes that start elsewhere too; see `remove_repeats` for nulls and repeats."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in pieces, packed into sequences of 2048; see `pack` for nulls, repeats and empty tables."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness; see `fingerprints` for nulls and repeats."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op11_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from positives and unlabelled text: doc_id, held_out, score, predicted; see `quality.score` for nulls and repeats.

    A row without doc_id is not held out. Without labels every score is 0.5. No rows give none.
    """
    docs, held = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 5)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), held)
    scored = quality.score(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of them with a period planted as the contract has it; see `find_runs` for nulls and repeats."""
    text = periodic_runs.with_planted_period(F.col("doc_id"), F.col("text"))
    return periodic_runs.digests(periodic_runs.find_runs(table(spark, sf_dir, "documents"), text))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two vocabularies' ids of every document, with corpus-wide counts of linked pairs; see `link_counts` for nulls and repeats."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.link_counts(table(spark, sf_dir, "documents"), *paths)


QUERIES = {
    "op1_repair_token_ids": op1_repair_token_ids,
    "op2_crf_language_id": op2_crf_language_id,
    "op3_chosen_path_join": op3_chosen_path_join,
    "op4_warc_zstd": op4_warc_zstd,
    "op5_simhash_decontamination": op5_simhash_decontamination,
    "op6_site_line_frequency": op6_site_line_frequency,
    "op7_zstd_toxicity": op7_zstd_toxicity,
    "op8_log_suffix_dedup": op8_log_suffix_dedup,
    "op9_nnls_packing": op9_nnls_packing,
    "op10_bottom_k": op10_bottom_k,
    "op11_pu_quality": op11_pu_quality,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE = {
    "op6_site_line_frequency": f"""
WITH pages AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT DISTINCT doc_id, source, unnest(ls) AS line FROM pages),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (
  SELECT l.source, l.line
  FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE trim(l.line) <> ''
  GROUP BY l.source, l.line, t.pages
  HAVING count(*) >= {site_lines.MIN_PAGES} AND count(*) > {site_lines.RATIO} * t.pages),
placed AS (
  SELECT doc_id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM pages),
kept AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.pos) AS text, count(*) AS n
  FROM placed p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source AND p.line = b.line
  WHERE b.line IS NULL
  GROUP BY p.doc_id)
SELECT d.doc_id, len(p.ls)::BIGINT AS n_lines, coalesce(k.n, 0)::BIGINT AS n_kept,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d JOIN pages p USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
}
