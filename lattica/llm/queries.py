"""The query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, licenses, neardup, packing, quality, tokenfiles, toxicity, vptree, warc
from .common import fold_of, table
from .tokens import vocabulary_path


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, is_kept) of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_kept")


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, shard, ids_crc32) of every record of the files, read back."""
    files, layout = tokenfiles.write_token_files(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return tokenfiles.read_token_files(files, layout).select("slot", "shard", F.crc32("ids").alias("ids_crc32"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs = table(spark, sf_dir, "documents")
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    return classifier.score(docs, model).select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words) of every document."""
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, license, kind, rule, licenses, identifiers, n_sentences) of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every document; evidence: JSON of the nearest examples."""
    docs = table(spark, sf_dir, "documents")
    index = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, index).select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.to_json("evidence").alias("evidence"))


def op8_vantage_points(spark: SparkSession, sf_dir: str, factor: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the 10 nearest of the vectors whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.search(vectors, vptree.build_index(vectors), F.col("id") % 100 == 0, k=10, factor=factor)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from the archives."""
    files, _ = warc.write_warc(warc.mark_revisits(table(spark, sf_dir, "pages")))
    return warc.page_records(warc.read_warc(spark, files)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame, runs: int = 600_000) -> DataFrame:
    pieces = packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), capacity=1024, end_id=0, runs=runs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_near_duplicates, op2_bpe_roundtrip, op3_token_files, op4_quality_classifier, op5_line_frequency, op6_license_scan, op7_toxicity, op8_vantage_points, op9_warc, op10_harmonic_packing]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_frequency": quality.judge_sql(), "op6_license_scan": licenses.scan_sql(), "op8_vantage_points": OP8_SQL, "op9_warc": OP9_SQL}


OP8_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""

OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS best FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM p JOIN m USING (payload_digest)"""
