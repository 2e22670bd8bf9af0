"""One query per operator, each over all rows of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealflow.llm import (
    decontaminate,
    fingerprints,
    infilling,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    near_dup,
    pii,
    spelling,
    suffix_dedup,
    vector_dedup,
    warc,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality(labels: DataFrame) -> DataFrame:
    """Weights of labelled documents: 2 for good ones, 1 for others."""
    return labels.filter("doc_id is not null").select(
        "doc_id", (F.coalesce("quality", F.lit(0)) + F.lit(1.0)).alias("weight")
    )


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.archived(table(spark, folder, "pages"))
    return warc.read(archives, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    short = line_dedup.shortened(table(spark, folder, "documents"))
    return short.select("doc_id", "n_lines", "n_removed", "text")


def op3_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(table(spark, folder, "documents"))
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compared(table(spark, folder, "documents"))


def op6_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    named = pii.surrogated(table(spark, folder, "documents"))
    return named.select("doc_id", "n_entities", "text")


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    settings = near_dup.Settings(words=2, percent=80)
    found = near_dup.components(table(spark, folder, "documents"), settings=settings)
    return found.drop("text_hash")


def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    mix = mixing.mix(docs, quality(table(spark, folder, "labels")))
    first = ["doc_id", "size", "source_size", "target", "taken"]
    return mix.select(*first, *[c for c in mix.columns if c not in first])


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.contaminated(docs, benchmark)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit(language_id.training_rows(docs))
    named = language_id.predict(docs, model, keep={"doc_id": "doc_id"})
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return named.select(
        "doc_id",
        F.coalesce(remainder == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.round("score", 6).alias("score"),
    )


def op11_embedding_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.components(table(spark, folder, "embeddings"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    settings = spelling.Settings(drop=97)
    found = spelling.variants(table(spark, folder, "documents"), settings=settings)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = infilling.transformed(table(spark, folder, "documents"))
    digests = {
        "output_sha256": F.sha2(F.col("output").cast("binary"), 256),
        "restored_sha256": F.sha2(infilling.restored(F.col("output"), F.col("form")).cast("binary"), 256),
    }
    return cut.withColumns(digests).drop("output")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_line_dedup": op2_line_dedup,
    "op3_repeated_strings": op3_repeated_strings,
    "op4_license_scan": op4_license_scan,
    "op5_fingerprints": op5_fingerprints,
    "op6_surrogates": op6_surrogates,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_mix_sources": op8_mix_sources,
    "op9_decontaminate": op9_decontaminate,
    "op10_language_id": op10_language_id,
    "op11_embedding_duplicates": op11_embedding_duplicates,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_fill_in_middle": op13_fill_in_middle,
}
