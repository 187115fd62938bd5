"""Benchmark decontamination by spaced seeds.

A mask looks at some positions of a window of words and ignores the others, so a changed
word at an ignored position leaves the hash as it is. Windows of documents whose hash is
one of the benchmark's are joined with it; around each hit, document and item are compared
word by word. Built-in functions only.

The benchmark is taken in blocks of a fixed number of hashes, which are literals of the
filter over the documents; so only hits are ever shuffled, however large either side is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.quality_rules import bound
from millrace.sources.staging import stage

# Positions of a window that a mask looks at. Wherever two words of RUN are changed, one of
# the masks fits somewhere between them with all its positions unchanged.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
# A hit counts if, somewhere over the hit, RUN words of both differ in at most RUN - AGREE.
RUN, AGREE = 13, 11
# Benchmark hashes that one pass over the documents looks for.
BLOCK = 100_000


def word_hashes(text: Column) -> Column:
    """Hashes of lower-case words without punctuation; NULL is an empty text."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]+", "")
    words = F.array_remove(F.split(plain, r"\s+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seed(words: Column, start: Column, mask: int) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(words, start + offset) for offset in MASKS[mask]])


def starts(words: Column, mask: int) -> Column:
    """Where a mask fits; nowhere in a shorter text."""
    span = MASKS[mask][-1] + 1
    return F.when(F.size(words) >= span, F.sequence(F.lit(0), F.size(words) - span)).otherwise(
        F.array().cast("array<int>")
    )


def placed(words: Column, at: Column, mask: int) -> Column:
    """(hash, start) of the windows that start at `at`."""
    return F.transform(at, lambda i: F.struct(seed(words, i, mask).alias("hash"), i.alias("start")))


def seeds_of(words: Column) -> Column:
    """(hash, start) of all windows under all masks."""
    return F.concat(*[placed(words, starts(words, mask), mask) for mask in range(len(MASKS))])


def hits_of(words: Column, wanted: list[int]) -> Column:
    """(hash, start) of the windows whose hash is wanted."""
    def hit(mask: int) -> Column:
        return F.filter(starts(words, mask), lambda i: seed(words, i, mask).isin(wanted))

    return F.concat(*[placed(words, hit(mask), mask) for mask in range(len(MASKS))])


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, agreeing) for documents that hold a passage of an item, each pair once.

    agreeing is the largest number of agreeing words in RUN aligned words. Texts are compared
    as lower-case words without punctuation; items and documents of fewer than RUN words
    match nothing, as do NULL texts. Repeated rows of one doc_id give one row for each item;
    a NULL doc_id or item_id stays NULL. Empty tables give no rows; other columns are not
    read.
    """
    items = stage(benchmark.select("item_id", word_hashes(F.col("text")).alias("words")), "items")
    seeds = stage(
        items.select("item_id", F.explode(seeds_of(F.col("words"))).alias("s")).select(
            "item_id", "s.hash", F.col("s.start").alias("at")
        ),
        "seeds",
    )
    n_blocks = max(1, -(-seeds.select("hash").distinct().count() // block))
    words = docs.select("doc_id", word_hashes(F.col("text")).alias("words"))
    found = []
    for number in range(n_blocks):
        mine = seeds.filter(F.pmod(F.xxhash64("hash"), F.lit(n_blocks)) == number)
        wanted = [r[0] for r in mine.select("hash").distinct().collect()]
        if not wanted:
            continue
        hits = bound(F.col("words"), lambda w: hits_of(w, wanted))
        held = words.select("doc_id", "words", hits.alias("hits")).filter(F.size("hits") > 0)
        key = F.struct("doc_id", F.xxhash64("words"), F.size("words"))
        held = stage(held.select(key.alias("key"), "words", "hits"), "hits")
        aligned = (
            held.select("key", F.explode("hits").alias("hit"))
            .select("key", "hit.hash", "hit.start")
            .distinct()
            .join(mine, "hash")
            .select("key", "item_id", (F.col("start") - F.col("at")).alias("shift"))
            .distinct()
        )
        texts = held.select("key", "words").dropDuplicates(["key"])
        both = aligned.join(texts, "key").join(
            items.select(F.col("item_id").alias("_item"), F.col("words").alias("item")),
            F.col("item_id").eqNullSafe(F.col("_item")),
        )
        found.append(both.select("key.doc_id", "item_id", agreement().alias("agreeing")))
    if not found:
        return words.filter(F.lit(False)).select(
            "doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("agreeing")
        )
    all_found = reduce(DataFrame.unionByName, found).filter(F.col("agreeing") >= AGREE)
    return all_found.groupBy("doc_id", "item_id").agg(F.max("agreeing").alias("agreeing"))


def agreement() -> Column:
    """The most agreeing words in RUN words of `item` laid over `words` at `shift`."""
    doc, item, shift = F.col("words"), F.col("item"), F.col("shift")
    same = F.transform(item, lambda w, j: F.coalesce(F.get(doc, j + shift) == w, F.lit(False)).cast("int"))

    def best(flags: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(1), F.size(flags) - RUN + 1),
            lambda j: F.aggregate(F.slice(flags, j, RUN), F.lit(0), lambda a, b: a + b),
        )
        return F.array_max(runs)

    return F.when(F.size(item) >= RUN, bound(same, best)).otherwise(0)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark; rows that share a doc_id are judged by their own texts."""
    row = F.xxhash64("doc_id", "text")
    bad = contaminated(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, row == F.col("_bad"), "left_anti")
