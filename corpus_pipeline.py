"""Corpus pipeline: quality, near duplicates, benchmark leaks, personal data, packing.

Each stage works on all rows that its predecessor kept, its result is written as Parquet and read again, and all but the last
return the columns of documents. Rows that a stage rejects are gone for good; the personal-data stage keeps every row and
masks the spans in its text. The last stage returns one row for each packed segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, near_dup, packing, pii, quality_lm
from foliant.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_lm.filter_rows(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.filter_rows(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.filter_rows(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("pii", personal_data),
    ("packing", packed),
]

#: Trained models, sketches and dynamic programming aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
