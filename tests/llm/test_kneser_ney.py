"""The model's shards, how they are merged and how they are looked up."""

import os
from collections import Counter

import numpy as np
import pytest

from millrace.llm import kneser_ney as kn
from millrace.llm.lm_scoring import lm_scores
from millrace.llm.words import mixed
from tests.llm.test_models import Plain, tokens


def test_shards_stay_few_as_the_corpus_grows():
    assert kn.shards_for(0) == 4 and kn.shards_for(400_000_000) == 100
    assert kn.shards_for(10_000_000_000) <= 640 and kn.shards_for(50_000_000_000) <= 3_200
    found = [kn.shards_for(n) for n in range(0, 20_000_000_000, 100_000_000)]
    assert found == sorted(found)


def test_a_scorer_opens_each_file_once(monkeypatch):
    opened, kinds = Counter(), {"pairs": np.uint64, "words": np.uint64, "counts": np.uint8, "stats": kn.STATS}

    def mapped(path):
        opened[os.path.basename(path)] += 1
        return np.zeros(1, kinds[os.path.basename(path).split("-")[0]])

    monkeypatch.setattr(kn, "mapped", mapped)
    every = frozenset(range(600))
    model = kn.Model("", 600, 10, 5, 8, (1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), {"pairs": every, "words": every})
    scorer = kn.Scorer(model)
    for i in range(3):
        scorer([" ".join(f"{i}w{j}" for j in range(20_000)).encode()])
    assert len(opened) > 2_000 and set(opened.values()) == {1}


def blob(rng, words, n, shards, shard):
    """Packed pairs of a shard, sorted by key, some with large counts."""
    v, w = (words[rng.integers(0, len(words), n)] for _ in range(2))
    keys, first = np.unique(mixed(v, w), return_index=True)
    first = first[kn.shard_of(keys, shards) == shard]
    counts = np.where(rng.random(len(first)) < 0.05, rng.integers(200, 1 << 20, len(first)), 2).astype(np.uint32)
    return kn.packed_pairs(v[first], w[first], counts)


def test_a_shard_is_the_same_merged_whole_or_by_ranges():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 48, 40, dtype=np.uint64)
    blobs = [blob(rng, words, n, 3, 1) for n in (900, 1, 300, 900, 0)]
    pairs = Counter()
    for b in blobs:
        for v, w, n in zip(*kn.unpacked_pairs(b)):
            pairs[int(v), int(w)] += int(n)
    whole = kn.merged(blobs, 1, 3, 10**9)
    keys, small, (places, large), stats, totals = whole
    assert len(keys) == len(pairs) and (keys[1:] > keys[:-1]).all() and len(places) == len(large) > 5
    counts = small.astype(np.int64)
    counts[places] = large
    expected = {int(mixed(np.array([v], np.uint64), np.array([w], np.uint64))[0]): n for (v, w), n in pairs.items()}
    assert dict(zip(keys.tolist(), counts.tolist())) == expected
    assert totals.tolist() == [sum(n == i for n in pairs.values()) for i in (1, 2, 3, 4)] + [len(pairs)]
    assert stats["c"].sum() == stats["total"].sum() == sum(pairs.values())
    for rows in (1, 7, 100, 500):
        assert all((a == b).all() for a, b in zip(kn.merged(blobs, 1, 3, rows), whole))


def test_sorting_equals_argsort():
    rng = np.random.default_rng(3)
    near = np.uint64(1 << 40) + rng.integers(0, 4, 50, dtype=np.uint64)  # differ in the replaced bits alone
    spread = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    cases = (spread, np.append(spread, near), np.repeat(spread[:100], 9), near, spread[:0], spread[:1], np.zeros(5, np.uint64),
             np.append(spread[:30], np.array([0, 2**64 - 1], np.uint64)), spread >> np.uint64(16))
    for hashes in cases:
        assert (kn.sorting(hashes) == np.argsort(hashes, kind="stable")).all()


def test_large_counts_are_found(spark):
    texts = ["a b " * 400 + "c", "a b c d " * 300, "b c " * 254 + "b", "x y", "a x"]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    found = lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    plain = Plain([rows[r.doc_id][1] for r in found if not r.held_out])
    assert max(plain.pairs.values()) > 255
    for r in found:
        words = tokens(rows[r.doc_id][1])
        score = sum(np.log10(plain.p(a, w)) for a, w in zip(["", *words[:-1]], words))
        assert (r.n_tokens, r.train_tokens) == (len(words), plain.n) and r.score == pytest.approx(score)
