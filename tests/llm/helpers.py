"""Small tables that every operator's tests use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and blank texts, one long text, repeated rows and ids, odd characters.
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, " \t\n ", None, "a", None),
    (4, "one", "en", "a", 3),
    (4, "one", "en", "a", 3),
    (None, "a row without an id has words too", "en", "a", 3),
    (5, "word " * 30_000, "en", "b", 5),
    (6, "café naïve 你好 \U0001f600 İstanbul ßẞ ́x it's WE'LL 12½3 a b c\x85d \x1c\x1d <|endoftext|> क्ष", "xx", "b", 6),
    (7, "line one of three\nline two of three\nline one of three", "en", "b", 7),
    (7, "same id, other text", "en", "b", 8),
]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A documents table of (doc_id, text) or whole rows."""
    return spark.createDataFrame([r if len(r) == 5 else (*r, "en", "s", len(r[1] or "")) for r in rows], SCHEMA)


def odd(spark: SparkSession) -> DataFrame:
    return frame(spark, ODD)


def clashing(docs: DataFrame) -> DataFrame:
    """The same with columns named like those that operators make."""
    for name in ("key", "value", "label", "score", "ids", "word_key", "text_hash", "bucket", "host", "rank", "row_id", "kept", "is_kept", "_id", "_hash", "_lines", "_row_id", "_kept_id"):
        docs = docs.withColumn(name, docs["lang"])
    return docs


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def documents(spark: SparkSession, folder: str = SF) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
