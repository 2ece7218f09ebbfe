"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``docs``.

Rows with a null id can't be named by any result and go in the first stage; of
rows that repeat an id and a text one goes on. An empty table passes through
as an empty table.

The stages hold the session's Arrow batches to runtime.BATCH_BYTES: executors keep
what they have grown to from stage to stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordtide.llm import exact_dedup, language_id, near_dedup, packing, pii, runtime


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted."""
    return language_id.accept(spark, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.deduplicate(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.deduplicate(spark, docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without personal data, secrets and terms that disclose them; n_chars is that of the new text."""
    found, gone = runtime.fresh(docs, "_entities"), runtime.fresh(docs, "_removed")
    done = pii.sanitise(spark, docs, found, gone)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(found) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training windows."""
    return packing.pack(spark, docs)


def _bounded(stage):
    """``stage`` in small Arrow batches; those of what it returns are made later, so the limit stays."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        runtime.small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", _bounded(languages)),
    ("exact_dedup", _bounded(exact)),
    ("near_dedup", _bounded(near)),
    ("pii", _bounded(private)),
    ("packing", _bounded(windows)),
]

#: Language models, minwise trees and online packing can't be expressed in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    base = runtime.shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = runtime.stored(stage(spark, docs, sf_dir), f"{base}/{k}-{name}")
        if k:
            runtime.forget(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
