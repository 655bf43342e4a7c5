"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. language ID: documents in which no language can be told go;
2. line dedup: lines that smaller documents hold leave the texts;
3. SimHash near-dedup: one document of each group stays (five-word shingles, similarity 0.8 or more, verified);
4. benchmark decontamination: documents that contain a test item go;
5. mixing: each source's documents are repeated or left out towards its target.

Stages 1 to 4 return the columns of documents; the mix adds ``repetition``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolink.llm import decontaminate, language, lines, mixing, simhash
from foliolink.llm.common import store


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their shared lines; a document whose text all goes stays, with an empty text."""
    done = lines.dedup_lines(docs)
    changed = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return done.withColumns(changed).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, find=simhash.near_copies)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: Trigram likelihoods and SimHash can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
