"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next one.

Defined cases, of every stage: an empty table gives an empty one; all columns are kept, whatever their names, but the last
stage's rows are pieces; very long texts are taken whole. A null or empty text has no term and no neighbour (toxicity: the score
of texts without one), fails the quality rules, so it reaches no later stage of a run, is a class of its own among
near-duplicates, and packs as its end id alone. Null ids, languages and sources stay; a null source is the empty host.
Repeated rows share each verdict, and one of them is left by the near-duplicates; of texts of one class the least id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import neardup, quality, toxicity
from lattica.llm.common import materialise, table
from lattica.llm.queries import packed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 7 scores 0.5 or more go."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 5 rejects go; frequent lines leave the texts of the others."""
    return quality.apply(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of operator 1 stays."""
    return neardup.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10's pieces; fewer runs are remembered, as other stages use the same workers."""
    return packed(docs, runs=200_000)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_low_quality), ("near-duplicates", drop_near_duplicates), ("packing", pack_sequences)]

#: No SQL: toxicity and near-duplicates are learnt and sketched; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
