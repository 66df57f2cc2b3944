"""Corpus preparation from raw documents to packed training windows.

Each stage takes what the one before kept, as a table of documents, and returns the
table that goes on; the last returns packed pieces. ``run`` writes every stage's
result to the shared folder before the next one reads it, so a lost executor repeats
one stage at most. The stages' defined results for nulls, empty texts, ties and
repeated rows are those of the operators that they call. Rows that repeat both a doc_id
and its text are one document: they stay or go together. Of rows that share a doc_id with
other texts, and of rows without one, none is taken for another. Columns besides doc_id
and text pass through, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontam, exact, neardup, packing, toxicity
from textloom.storage import bound_batches, materialize, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    bound_batches(spark)
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8) one stays."""
    bound_batches(spark)
    return neardup.keep_one(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item go."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of full windows."""
    bound_batches(spark)
    return packing.production(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A learnt model and a tokenizer are beyond SQL; tests/llm holds a brute-force version against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
