"""Quality classifier: perplexity under a model of trusted text, judged by language.

The count arrays are sharded by hash; each block of documents sorts its pair hashes and
merges them with one shard after the other, so the join moves no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.hash_files import hash_set
from millrace.llm.kneser_ney import scored, train

# Share of trusted text above whose perplexity a language's documents are rejected.
QUANTILE = 0.995
# Trusted rows of one fold set the thresholds, the others train the model.
FOLDS, CALIBRATION = 5, 1
BLOCK = 4_000_000  # bytes of text that a task counts at once
# Documents' worth of the threshold of all languages that goes into that of each language.
PRIOR = 20


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """docs with log10_perplexity and keep.

    Trusted text is that of documents labelled quality 1 and toxic 0, all of it. Four
    fifths of it (by crc32 of the id) train a Kneser-Ney model, the rest gives each
    language the quantile of log10 perplexity above which documents are rejected: the mean
    of its own and that of all, weighted by its number of calibration documents and PRIOR.
    NULL is a language; one without calibration documents has the quantile of all.

    An empty or NULL text has the perplexity of an end without words and is rejected: it
    has nothing to keep. Without trusted text nothing else is rejected. Repeated rows get
    the same verdict each. Columns of docs called score, n_tokens, log10_perplexity or keep raise.
    """
    clash = {"score", "n_tokens", "log10_perplexity", "keep"} & set(docs.columns)
    if clash:
        raise ValueError(f"docs already has {sorted(clash)}")
    trusted = labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull())
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    key = F.xxhash64("doc_id")
    rows = docs.select("doc_id", "lang", "text").filter(F.col("doc_id").isNotNull())
    known = {"key": key, "found": hash_set(trusted.select(key.alias("key")), "trusted-ids")}
    model = train(rows.filter(fold != CALIBRATION), label="trusted", block=BLOCK, **known)

    def perplexity(df: DataFrame, **only) -> DataFrame:
        found = scored(df, model, names=("score", "n_tokens"), **only)
        return found.withColumn("log10_perplexity", -F.col("score") / F.col("n_tokens")).drop("score", "n_tokens")

    held = perplexity(rows.filter(fold == CALIBRATION), **known).filter(F.length(F.trim("text")) > 0)
    # A bounded summary: one row for each language, at most a few hundred.
    limits = (
        held.groupBy("lang")
        .agg(F.percentile_approx("log10_perplexity", quantile, 10_000).alias("most"), F.count("*").alias("n"))
    )
    overall = held.agg(F.percentile_approx("log10_perplexity", quantile, 10_000)).first()[0]
    limit = F.lit(overall if overall is not None else float("inf")).cast("double")
    for row in limits.collect():
        most = (row["n"] * row["most"] + PRIOR * overall) / (row["n"] + PRIOR)
        limit = F.when(F.col("lang").eqNullSafe(F.lit(row["lang"])), F.lit(most)).otherwise(limit)
    has_words = F.coalesce(F.regexp_like(F.col("text"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    return perplexity(docs).withColumn("keep", has_words & (F.col("log10_perplexity") <= limit))
