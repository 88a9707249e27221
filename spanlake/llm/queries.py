"""Registered queries of the operators: each applies one operator, with its production
parameters, to the whole of its table and derives the columns that the contract asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import (
    best_fit, conversation_repair, decontaminate, hard_negatives, html_content, language_mix, line_dedup, matrix_knn, near_dedup, secret_scan, source_mix, toxicity, warc_chunks,
)
from spanlake.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"), "n_weak")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_content.extract(pages, html_content.learn_weights(pages))


def op3_matrix_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_knn.nearest(table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_lines", "n_removed", F.coalesce(F.array_join(F.transform("covered", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"),
        F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.round_trip(table(spark, sf_dir, "pages"))


def op8_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_mix.identify(docs, language_mix.train(docs))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_mix.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report_all(table(spark, sf_dir, "conversations"))


def op12_best_fit(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:  # a public file, beside the library
        return best_fit.pack_documents(table(spark, sf_dir, "documents"), f.read())


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", label.alias("label")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_main_text, op3_matrix_knn, op4_line_dedup, op5_toxicity, op6_near_dedup, op7_warc_chunks, op8_language_mix,
        op9_source_mix, op10_decontaminate, op11_conversation_repair, op12_best_fit, op13_hard_negatives,
    )
}
