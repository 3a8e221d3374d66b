"""The corpus pipeline: quality rules, quality classifier, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every document that its predecessor kept, and returns documents with
all their columns; the last returns the packed pieces. A stage's result is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import decontamination, ngram_join, packing, quality_classifier, quality_rules
from lakeweave.llm.common import crc_remainder, table, written
from lakeweave.llm.queries import tokenizer


def pass_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of policy v1."""
    return quality_rules.kept_documents(docs, "v1")


def pass_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more; the model learns from the corpus as it came, without the held-out labels."""
    model = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 4) != 2)
    return quality_classifier.kept_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more, the one with the least id."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack(docs, tokenizer()).drop("ids")


STAGES = [
    ("quality_rules", pass_rules),
    ("quality_classifier", pass_classifier),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: Model scoring, similarity and packing have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
