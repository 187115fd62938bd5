"""URL filter: host and path rules, then a blocked Bloom filter before an exact join.

The filter holds the listed canonical URLs in blocks of four 64-bit lanes, one bit a lane;
it is a table of Spark rows, so it may be as large as the list. Pages probe one block each,
and only possible hits go to the exact join. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Listed URLs for each block of 4 x 64 bits: about 0.3 % false hits.
PER_BLOCK = 16
LANES = 4


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www., path without closing slashes; NULL without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", "")))


def bloom_key(url: Column, blocks: int) -> dict[str, Column]:
    """The block of a URL and its bit in each lane."""
    spread = F.xxhash64(F.lit(1), url)
    lane = {
        f"lane{i}": F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        )
        for i in range(LANES)
    }
    return {"block": F.pmod(F.xxhash64(F.lit(0), url), F.lit(blocks)), **lane}


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, lane0..lane3) of a column `canonical` of distinct URLs."""
    keyed = listed.select(*[c.alias(n) for n, c in bloom_key(F.col("canonical"), blocks).items()])
    return keyed.groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"set{i}") for i in range(LANES)])


def listed_among(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct `canonical` of urls that are listed: Bloom filter first, exact join after."""
    entries = listed.select("canonical").filter(F.col("canonical").isNotNull()).distinct()
    blocks = max(1, -(-entries.count() // PER_BLOCK))
    probes = urls.select("canonical").filter(F.col("canonical").isNotNull()).distinct()
    probes = probes.withColumns(bloom_key(F.col("canonical"), blocks))
    passed = F.lit(True)
    for i in range(LANES):
        passed = passed & (F.col(f"lane{i}").bitwiseAND(F.col(f"set{i}")) != 0)
    possible = probes.join(bloom_filter(entries, blocks), "block").filter(passed).select("canonical")
    return possible.join(entries, "canonical", "left_semi")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else NULL.

    rules: (verdict, host/path) pairs, a policy of at most a few hundred. A rule fits its
    host and all subdomains, if the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(set(rules), key=lambda r: (len(r[1]), r)):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    A fitting rule decides; otherwise a page is blocked if its canonical URL is one of
    those of listed (url), and allowed if not. A NULL url or one without :// has an empty
    host and path, fits no rule, is on no list and is allowed. Repeated rows are judged
    each, ids may be NULL, other columns are not read, empty tables give no rows.
    """
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    urls = parts.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    entries = listed.select(canonical(host_of(url), path_of(url)).alias("canonical"))
    hits = listed_among(urls, entries).withColumn("hit", F.lit(True))
    found = urls.join(hits, "canonical", "left").withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("hit"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))
