"""From raw documents to packed training sequences, a stage at a time.

Each stage is (spark, docs, sf_dir) -> DataFrame over all rows that the stage before it kept; its result is
written as Parquet and read again. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import containment, dart_minhash, packing, secrets, toxicity
from ledgerloom.llm.common import materialize, table


#: A number for each row of a stage's input.
ROW = "__row"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; those without text stay."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies one row stays: that of the smallest doc_id, of rows without an id only if there are no others.

    Every row is compared under a number of its own, so repeated rows of a doc_id and rows without one are copies
    like any other. A null text equals none, but repeats of its doc_id go; without text and doc_id a row stays.
    """
    rows = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")
    found = dart_minhash.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "class_id")
    member = rows.select(ROW, "doc_id", F.col("text").isNull().alias("t")).join(found.hint("merge"), ROW)
    null = F.col("t")
    key = F.struct(F.when(null, F.coalesce("doc_id", ROW)).otherwise(F.col("class_id")).alias("k"), F.when(null, F.col("doc_id").isNull()).alias("bare"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW))[ROW].alias(ROW)
    kept = materialize(member.groupBy(key.alias("key")).agg(first).select(ROW), "pipeline-kept")
    return rows.join(kept.hint("merge"), ROW, "left_semi").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's shingles go."""
    return containment.without_contained(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets give way to a mark, and n_chars follows."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each_class),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Trained scores, tokenisation and best-fit are beyond SQL; tests/llm checks every stage by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
