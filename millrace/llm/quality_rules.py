"""Quality rules by host: rule failures of documents, shrunk failure rates of hosts, verdicts.

All measures of a text are built-in functions over its own words; repeated windows are
found by sorting their hashes, so a text of n words costs n log n and nothing is shuffled
but one small row a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.sources.staging import stage

WORD, BLANKS = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+"
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; percent of words in repeated windows
MOST_SYMBOLS, MOST_DUP_LINES = 10, 30  # symbols for 100 words; percent of lines
RULES = ("base", "symbols", "dup_lines")
# Shrunk rate of a rule's failures from which a whole host is rejected.
HOST_MOST = 0.5
# Bounds of the prior's strength in documents.
STRENGTH = (1.0, 10_000.0)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, though body's lambdas use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_window_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more."""
    def windows(w: Column) -> Column:
        ends = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(ends, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bound(placed, lambda s: bound(F.sort_array(repeated(s)), count))

    def repeated(s: Column) -> Column:
        return F.transform(F.filter(s, lambda x, i: equal(s, i - 1, x) | equal(s, i + 1, x)), lambda x: x["i"])

    def equal(s: Column, i: Column, x: Column) -> Column:
        return F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))

    def count(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - x), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    any_repeated = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))
    return F.when(F.size(words) >= 4, bound(windows(words), any_repeated)).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, BLANKS), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    made = docs.select("doc_id", "source", text.alias("text"), words.alias("words"), lines.alias("lines"))
    return made.select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    words = F.col("n_words")
    return {
        "base": (words < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * words),
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * words,
        "dup_lines": 100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(source, n_docs, rate_<rule>..., host_kept): failure rates shrunk to a beta prior of all hosts.

    The prior of a rule has the mean and variance of the hosts' rates (moments); a host of
    few documents stays near it, a large one near its own rate.
    """
    counts = measured.groupBy("source").agg(
        F.count("*").alias("n_docs"), *[F.count_if(c).alias(f"failed_{r}") for r, c in failures().items()]
    )
    rate = lambda r: F.col(f"failed_{r}") / F.col("n_docs")
    moments = counts.agg(
        *[F.avg(rate(r)).alias(f"mean_{r}") for r in RULES], *[F.var_pop(rate(r)).alias(f"var_{r}") for r in RULES]
    ).first()
    shrunk = {}
    for r in RULES:
        mean, var = moments[f"mean_{r}"] or 0.0, moments[f"var_{r}"] or 0.0
        k = min(max(mean * (1 - mean) / var - 1, STRENGTH[0]), STRENGTH[1]) if var > 0 else STRENGTH[1]
        shrunk[f"rate_{r}"] = (F.col(f"failed_{r}") + mean * k) / (F.col("n_docs") + k)
    found = counts.withColumns(shrunk)
    return found.select(
        "source", "n_docs", *shrunk, (F.greatest(*[F.col(c) for c in shrunk]) < HOST_MOST).alias("host_kept")
    )


def judge_documents(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: its measures, base_failed, failed rules, host verdict, kept.

    A document is kept if it fails no rule and its host's shrunk rate of failures is below
    HOST_MOST for every rule. A NULL text is empty (no words: base_failed); documents with
    NULL source form one host. Repeated rows are judged and counted each; an empty table
    gives no rows; other columns are not read.
    """
    measured = stage(measures(docs), "measures")
    hosts = host_verdicts(measured).select(F.col("source").alias("_host"), "host_kept")
    found = measured.join(hosts, F.col("source").eqNullSafe(F.col("_host")), "left").drop("_host")
    failed = failures()
    names = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in failed.items()]))
    return found.select(
        "*", failed["base"].alias("base_failed"), names.alias("failed"),
        ((F.size(names) == 0) & F.col("host_kept")).alias("kept"),
    )
