"""From raw documents to packed token sequences: five stages, each an operator of ``webtables.llm``.

Every stage takes what the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from webtables.llm import near_dup, packing, quality_rules, resampling, secret_scan
from webtables.llm.common import stored, table

#: Shingles of this many words, and the percentage of similarity, of near duplicates.
WORDS, PERCENT = 5, 80


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def small_batches(spark: SparkSession) -> None:
    """Texts are large rows: Python steps get few of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample leaves out go."""
    small_batches(spark)
    return resampling.keep_sampled(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    small_batches(spark)
    return near_dup.keep_one(docs, WORDS, PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and ``n_chars`` follows."""
    return secret_scan.redact(docs, "text", "n_chars")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("packing", sequences),
]

#: The classifier, the tokenizer and the packing cannot be said in SQL; ``tests/llm`` holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
