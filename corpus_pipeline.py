"""Documents to a training mix, in stages that each read what the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.llm import decontaminate, language_id, line_dedup, mixing, near_dup
from dealflow.llm.common import fresh, stored
from dealflow.llm.queries import quality, table

#: Least posterior probability of the language found; documents below, or without any, go.
LEAST_LANGUAGE_SCORE = 0.5

#: Language models, randomised SVD and signatures are not SQL; the tests use brute force.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep documents whose language is recognised; the model learns from three of four folds."""
    model = language_id.fit(language_id.training_rows(docs))
    return language_id.accepted(docs, model, LEAST_LANGUAGE_SCORE)


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Delete blocks of lines that an earlier document has; documents that lose all words go."""
    removed = fresh(docs, "n_removed")
    short = line_dedup.shortened(docs)
    short = short.filter((F.col(removed) == 0) | (F.trim("text") != "")).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return short
    kind = docs.schema["n_chars"].dataType
    return short.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    return near_dup.deduplicated(docs)


def clean(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, folder, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Words that each document gives to the mix of sources."""
    return mixing.mix(docs, quality(table(spark, folder, "labels")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", clean),
    ("mix_sources", mixture),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages; each result is stored and read again as the next one's documents."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
