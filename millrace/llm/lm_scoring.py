"""Language-model scoring of documents by an interpolated modified Kneser-Ney model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.kneser_ney import scored, train

FOLDS, HELD_OUT = 5, 1
BLOCK = 8_000_000  # bytes of text that a task scores at once


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row.

    The model learns from all rows whose crc32(doc_id) mod FOLDS is not HELD_OUT; a NULL
    doc_id is a training row. A NULL text counts as empty, and an empty text is one token,
    its end. Repeated rows are counted and scored each; other columns are not read. An
    empty table gives no rows.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    rows = docs.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    model = train(rows.filter(~F.col("held_out")))
    found = scored(rows, model, block=BLOCK).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
