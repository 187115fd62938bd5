"""Kneser-Ney scores, the quality classifier and host rules."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import kneser_ney as kn
from millrace.llm.lm_scoring import lm_scores
from millrace.llm.quality_classifier import classify
from millrace.llm.quality_rules import host_verdicts, judge_documents
from millrace.sources.tables import scan_parquet
from tests.llm.conftest import FOLDER

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tokens(text):
    return [*WORDS.findall(lower(text or "")), "\n"]


class Plain:
    """The same model by dictionaries."""

    def __init__(self, texts):
        self.c, self.pairs = Counter(), Counter()
        for t in texts:
            words = tokens(t)
            self.c.update(words)
            self.pairs.update(zip(["", *words[:-1]], words))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pred = Counter(w for _, w in self.pairs)
        self.total, self.follow = Counter(), {}
        for (a, b), n in self.pairs.items():
            self.total[a] += n
            self.follow.setdefault(a, Counter())[min(n, 3)] += 1
        self.low = kn.discounts(*(sum(x == i for x in self.pred.values()) for i in (1, 2, 3, 4)))
        self.high = kn.discounts(*(sum(x == i for x in self.pairs.values()) for i in (1, 2, 3, 4)))

    def lower(self, w):
        mass = sum(self.low[min(x, 3) - 1] for x in self.pred.values()) / len(self.pairs)
        n = self.pred[w]
        return (n - (self.low[min(n, 3) - 1] if n else 0)) / len(self.pairs) + mass / (self.v + 1)

    def p(self, a, w):
        if not self.total[a]:
            return self.lower(w)
        n = self.pairs[a, w]
        gamma = sum(self.high[i - 1] * k for i, k in self.follow[a].items()) / self.total[a]
        return (n - (self.high[min(n, 3) - 1] if n else 0)) / self.total[a] + gamma * self.lower(w)


def test_scores_equal_a_plain_model(documents):
    rows = documents.select("doc_id", "text").collect()
    held = {r.doc_id: crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    plain = Plain([r.text for r in rows if not held[r.doc_id]])
    found = {r.doc_id: r for r in lm_scores(documents).collect()}
    assert len(found) == len(rows)
    for r in rows[:60]:
        words, got = tokens(r.text), found[r.doc_id]
        assert (got.held_out, got.n_tokens, got.train_tokens) == (held[r.doc_id], len(words), plain.n)
        assert got.n_known == sum(plain.c[w] > 0 for w in words)
        base = sum(math.log10((plain.c[w] + 0.5) / (plain.n + 0.5 * (plain.v + 1))) for w in words)
        score = sum(math.log10(plain.p(a, w)) for a, w in zip(["", *words[:-1]], words))
        assert got.base_score == pytest.approx(base) and got.score == pytest.approx(score)
    better = [r.score > r.base_score for r in found.values() if r.held_out]
    assert sum(better) > 0.8 * len(better)


def test_probabilities_sum_to_one():
    plain = Plain(["a b a c", "b a b", "c c a"])
    for context in ("", "a", "b", "unseen"):
        assert sum(plain.p(context, w) for w in [*plain.c, "new"]) == pytest.approx(1)


def test_pairs_survive_packing():
    rng = np.random.default_rng(1)
    v, w = (rng.integers(0, 1 << 48, 1000, dtype=np.uint64) for _ in range(2))
    n = np.where(rng.random(1000) < 0.1, rng.integers(255, 1 << 20, 1000), 3).astype(np.uint32)
    assert all((a == b).all() for a, b in zip(kn.unpacked_pairs(kn.packed_pairs(v, w, n)), (v, w, n)))


def test_odd_rows_are_scored(odd, none):
    found = lm_scores(odd).collect()
    assert len(found) == 10 and all(math.isfinite(r.score) for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (3, 4, 5)} == {1}
    assert lm_scores(none).count() == 0


def test_classifier_parts_good_from_bad(spark):
    folder = FOLDER.replace("0.001", "0.01")  # the smallest table with enough trusted text
    labels = scan_parquet(spark, folder, "labels").dropDuplicates(["doc_id"])
    found = classify(scan_parquet(spark, folder, "documents"), labels).join(labels, "doc_id").collect()
    share = lambda q, t: np.mean([r.keep for r in found if (r.quality, r.toxic) == (q, t)])
    assert share(1, 0) > 0.9 and share(0, 0) < 0.2


def test_classifier_equals_a_plain_one(spark, documents):
    labels = scan_parquet(spark, FOLDER, "labels").dropDuplicates(["doc_id"])
    rows = documents.select("doc_id", "lang", "text").collect()
    trusted = {r.doc_id for r in labels.collect() if (r.quality, r.toxic) == (1, 0)}
    held = {r.doc_id: crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    plain = Plain([r.text for r in rows if r.doc_id in trusted and not held[r.doc_id]])

    def perplexity(text):
        words = tokens(text)
        return -sum(math.log10(plain.p(a, w)) for a, w in zip(["", *words[:-1]], words)) / len(words)

    own = {r.doc_id: perplexity(r.text) for r in rows}
    held_out = [r for r in rows if r.doc_id in trusted and held[r.doc_id] and (r.text or "").strip()]
    # The least value with at least that share of the values at or below it.
    quantile = lambda values: sorted(values)[math.ceil(0.995 * len(values)) - 1]
    overall, limits = quantile([own[r.doc_id] for r in held_out]), {}
    for lang in {r.lang for r in rows}:
        values = [own[r.doc_id] for r in held_out if r.lang == lang]
        limits[lang] = (len(values) * quantile(values) + 20 * overall) / (len(values) + 20) if values else overall
    found = {r.doc_id: r for r in classify(documents, labels).collect()}
    assert len(found) == len(rows)
    for r in rows:
        assert found[r.doc_id].log10_perplexity == pytest.approx(own[r.doc_id])
        if abs(own[r.doc_id] - limits[r.lang]) > 1e-9:
            assert found[r.doc_id].keep == (bool((r.text or "").strip()) and own[r.doc_id] <= limits[r.lang])


def test_a_missing_file_of_a_model_is_an_error(spark, documents):
    import os

    model = kn.train(documents.select("text"))
    assert model.written["pairs"] == model.written["words"] == frozenset(range(model.shards))
    os.remove(f"{model.folder}/pairs-0.npy")
    with pytest.raises(Exception, match="pairs-0.npy"):
        kn.scored(documents.select("text"), model).count()


def test_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    found = classify(odd, labels)
    assert found.count() == 10 and found.filter("keep").filter("trim(text) = '' OR text IS NULL").count() == 0
    assert classify(odd, labels.limit(0)).filter("keep").count() == 6
    assert classify(none, labels).count() == 0
    with pytest.raises(ValueError):
        classify(odd.withColumn("score", F.lit(1)), labels)
    with pytest.raises(ValueError):
        classify(odd.withColumn("keep", F.lit(1)), labels)


def measured(text):
    words = WORDS.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_rules_equal_brute_force(documents, odd):
    for docs in (documents, odd):
        texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        want = sorted(((d, *measured(t)) for d, t in texts), key=str)
        found = judge_documents(docs)
        got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found.collect()}
        assert sorted(got, key=str) == want and found.count() == docs.count()
        bad = [r for r in found.collect() if r.base_failed != (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)]
        assert not bad


def test_hosts_are_shrunk_and_bad_ones_go(spark, none):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "g") for i in range(40)] + [(100 + i, "bad", "b") for i in range(40)] + [(200, "bad", "small"), (201, good, "b")]
    rows += [(300 + i, good, f"h{i % 9}") for i in range(90)]
    found = judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {r.doc_id for r in found.filter("kept").collect()}
    assert kept == {*range(40), *range(300, 390)}
    hosts = {r.source: r for r in host_verdicts(found).collect()}
    assert not hosts["b"].host_kept and hosts["small"].rate_base < 1 and hosts["g"].rate_base < 0.05
    assert judge_documents(none).count() == 0
