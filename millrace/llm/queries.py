"""The numbered operators over their whole tables, and the pipeline; SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from millrace.llm import secrets, sql
from millrace.llm.alignment import align
from millrace.llm.decontamination import contaminated
from millrace.llm.html_text import extract_text
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.lm_scoring import lm_scores
from millrace.llm.ngram_join import jaccard_classes
from millrace.llm.packing import pack
from millrace.llm.quality_classifier import classify
from millrace.llm.quality_rules import judge_documents
from millrace.llm.suffix_dedup import without_repeats
from millrace.llm.url_filter import judge_urls
from millrace.llm.whitening import whiten
from millrace.sources.tables import scan_parquet as table

# The URL policy of op3.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Listed are the URLs of pages whose id is labelled toxic."""
    pages = table(spark, folder, "pages")
    toxic = table(spark, folder, "labels").filter("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    return judge_urls(pages, pages.select("page_id", "url").join(toxic, "page_id", "left_semi"), URL_RULES)


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = judge_documents(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_classes(table(spark, folder, "documents"))


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    found = classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "lang", "log10_perplexity", F.col("keep").alias("kept"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text")))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align(table(spark, folder, "documents"), *paths)


def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # Under this name the texts are replaced by what is kept of them, so they do not come back as well.
    found = without_repeats(table(spark, folder, "documents").select("doc_id", F.col("text").alias("kept")), "kept")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"), "vec_id", "embedding")


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_line_dedup, op3_url_filter, op4_quality_rules, op5_ngram_join, op6_html_extraction,
        op7_packing, op8_quality_classifier, op9_decontamination, op10_secret_scan,
        op11_token_alignment, op12_suffix_dedup, op13_whitening,
    )
} | {"pipeline": corpus_pipeline.run}

SQL: dict[str, str] = {
    "op3_url_filter": sql.url_filter(URL_RULES),
    "op4_quality_rules": sql.quality_by_host(),
    "op9_decontamination": sql.decontamination_pairs(),
}
