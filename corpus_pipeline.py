"""From raw documents to token files: quality rules, near duplicates, benchmark leaks, source weights, token ids.

Defined cases: a document with null text has no words and is rejected by the quality rules; a null doc_id, lang or source stays as it is, null being a source of its own
in the weights. Of rows that are equal, and of near copies, the one with the least doc_id stays (null last); of rows with equal id and text the first by all columns. Weights
repeat a row by its id, so rows that share an id are taken equally often. Extra columns come along to the weights, whatever their names; the last stage reads doc_id and text only.
An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import decontaminate, mixing, ngram_join, quality_rules, token_output
from stowage.llm.storage import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out until sources have their target weights."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed documents, and what is read back from them: place, length and checksum."""
    return token_output.tokenized(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", weights),
    ("token-ID output", tokens),
]
# Tokenizing and fingerprints are beyond SQL: tests hold the stages against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage reads the Parquet files of the one before."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
