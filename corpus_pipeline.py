"""The corpus pipeline: quality, language, lines, near duplicates, packing.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with
the columns of ``documents``; the last returns packed pieces. ``run`` writes each
stage's rows as Parquet in the shared folder and hands the reread table on.

Texts are whole and may be long, so a stage lowers the session's Arrow batches to
``BATCH_ROWS`` rows first; a Python worker then holds a few megabytes of text at a time.

Rows without text never pass the quality stage. Rows repeated in full pass or go
together. A null ``doc_id`` links with no near duplicate.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airtrace.llm import jaccard, language, lines, packing, quality
from airtrace.llm.tables import table
from airtrace.session import materialize

BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, min(BATCH_ROWS, int(spark.conf.get(key)) or BATCH_ROWS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the isolation forest."""
    _small_batches(spark)
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents speak."""
    _small_batches(spark)
    return language.filter_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a later one of at least three has too."""
    kept = lines.apply_bitmaps(docs, lines.bitmaps(docs))
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate class (five words, 0.8)."""
    _small_batches(spark)
    found = jaccard.classes(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of 1024 tokens."""
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids", "cost")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]
#: SQL cannot express the forest, the language models and the tokenizer; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
