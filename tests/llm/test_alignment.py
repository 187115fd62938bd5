import hashlib
import random
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import alignment
from millrace.llm.alignment import align, incidence, products

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    " ", "  ", "\n", "a", " a", "a ", "a\n", "\n\n  b", "x  \n\n y \n", "\ta\t\tb\t", "\x1c!\x1d?\x1e.\x1f", "a\x85b\xa0c　 d",
    "<|endoftext|>", "a<|endoftext|> b", "<s> </s> <unk> <0x41>", "naïve café", "東京都は日本の首都です。 東京", "😀😀 👩‍👩‍👧", "é ﬁ Ａ",
    "don't we'll I'M", "123456 78 9.0", ");\r\n}\r\n\r\n x", "\x00 a\x00", "▁a", "a ▁ b", " z  ﻿ q", "aaaaaaaaaaaaaaaaaaaaaaaa",
]


def whole_texts(texts):
    """Every column by whole texts, pairs of tokens and plain loops."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    both = alignment.Tokenizers(A, B)
    rows, held = [], Counter()
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [both.a_bytes[i] for i in x], [both.b_bytes[i] for i in y]
        if any(b"".join(p) != (" " + text).encode() for p in parts if text):
            x, y, parts = [], [], ([], [])
        ends = [np.cumsum([len(t) for t in p]).tolist() for p in parts]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((x, y)):
            for end, i in zip(ends[side], ids):
                groups[bisect_left(cuts, end)][side].append(i)
        links = [(i, j) for g in groups for i in g[0] for j in g[1]]
        held.update(set(links))
        said = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        rows.append((len(x), len(y), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if said else ""))
    best = Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [
        (n_a, n_b, n, len(links), digest, sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links))
        for n_a, n_b, n, links, digest in rows
    ]


def of(rows):
    return [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"], r["n_best"], r["count_sum"]) for r in rows]


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    for n, k, m in [(1, 1, 1), (7, 5, 9), (30, 20, 10)]:
        x, y = (rng.integers(0, 3, size=s) * rng.integers(0, 2, size=s) for s in ((n, k), (k, m)))
        sparse = [incidence(*np.nonzero(z), len(z), z[np.nonzero(z)]) for z in (x, y)]
        for most in (1, 8, 10_000):
            dense = np.zeros((n, m), np.int64)
            for rows, columns, values in products(*sparse, most):
                assert (dense[rows, columns] == 0).all()
                dense[rows, columns] = values
            assert (dense == x @ y).all()


def test_units_are_encoded_as_in_whole_texts():
    both, rng, whole = alignment.Tokenizers(A, B), random.Random(2), Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    alphabet = ["a", "B", "é", "東", "😀", " ", " ", "\n", "\t", "\r", ";", ")", "'s", "1", "▁", "\x1c", "\x85", "\xa0", "the", "ing", "<s>", "\x00"]
    assert both.cut is alignment.UNIT
    for text in ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(4000)]:
        units = both.units(text)
        assert "".join(units) == " " + text
        a, b = both.ids(units)
        assert [i for x in a for i in x] == whole.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert [i for x in b for i in x] == both.b.encode(text), repr(text)


@pytest.mark.parametrize("block", [40, 8_000_000])
def test_alignment_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = random.Random(4)
    words = ["the", "running", "Straße", "東京", "x1", "\n", "", "tokenization", "…", "é"]
    texts = [None, "", *ODD, *(" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)), "the the", "the the", "word " * 3000]
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, block string")
    found = align(docs.repartition(3), A, B).orderBy("doc_id").collect()
    assert of(found) == whole_texts(texts)


def test_details_hold_what_the_digests_say(spark, documents):
    some = documents.limit(40)
    for r in align(some, A, B, detail=True).collect():
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
        assert r["n_links"] == sum(x["links"] for x in r["links"])
        assert r["count_sum"] == sum(x["links"] * x["count"] for x in r["links"])


def test_odd_tables(spark, odd, none):
    assert align(none, A, B).collect() == []
    rows = odd.select("doc_id", "text").collect()
    found = align(odd, A, B).collect()
    ids = lambda rows: sorted(r["doc_id"] or -1 for r in rows)
    assert ids(found) == ids(rows)
    assert sorted(of(found)) == sorted(whole_texts([r["text"] for r in rows]))
