import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.llm import suffix_dedup
from millrace.llm.suffix_dedup import Shape, boundaries, repeated_strings, without_repeats
from millrace.llm.suffix_groups import suffix_array


def brute(texts, length):
    """(n_bytes, spans, kept) of each text by counting all its strings."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        out.append((len(d), list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(d, gone[1:]) if not g)))
    return out


def found(spark, texts, length, bucket=suffix_dedup.BUCKET, parts=3):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = without_repeats(docs.repartition(parts), length=length, bucket=bucket).orderBy("doc_id").collect()
    return [(r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in rows]


@given(st.lists(st.integers(0, 4), max_size=60))
@settings(max_examples=500, deadline=None)
def test_suffix_array_of_few_symbols(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("symbols", [[], [7], [3] * 300, list(range(300)), list(range(300, 0, -1)), [1, 2] * 150, [2, 1] * 150])
def test_suffix_array_of_patterns(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_suffix_array_of_many_symbols():
    rng = random.Random(1)
    for n in (1_000, 5_000):
        symbols = [rng.randrange(n) for _ in range(n)]
        assert suffix_array(symbols) == sorted(range(n), key=lambda i: symbols[i : i + 40])


@pytest.mark.parametrize("length", [4, 13, 40, 400])
def test_every_string_has_one_boundary_of_its_own_bytes(length):
    rng, shape = np.random.default_rng(length), Shape(length)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    data[1000:1600], data[3000:3900] = 7, data[100:1000]
    ends = np.array([700, 702, 2900, 5000])
    starts = np.append(0, ends[:-1])
    at, low, high, core = boundaries(data, starts, ends, shape)
    place = {}
    for q, a, b, c in zip(at.tolist(), low.tolist(), high.tolist(), core.tolist()):
        for t in range(a, b + 1):
            p = q - shape.window - t
            assert p not in place
            place[p] = t, c
    assert sorted(place) == [p for a, b in zip(starts, ends) for p in range(a, b - length + 1)]
    by_string = {}
    for p, value in place.items():
        assert by_string.setdefault(data[p : p + length].tobytes(), value) == value


@pytest.mark.parametrize("bucket", [0, 2, 256])
@pytest.mark.parametrize("length", [12, 60])
def test_equals_brute_force(spark, length, bucket):
    rng = random.Random(length)
    words = ["alpha", "béta", "γ", "delta", "e", "zeta zeta", "東京"]
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(n))
    shared = [prose(40), prose(25), "ab" * 80, "x" * 200, " ".join(rng.choices(words, k=60))]
    texts = [None, "", "short", shared[0], shared[0], shared[3]]
    for _ in range(60):
        parts = [prose(rng.randint(0, 30)), rng.choice(shared), prose(rng.randint(0, 9)), rng.choice(shared)]
        parts[1] = parts[1][rng.randint(0, 30) : len(parts[1]) - rng.randint(0, 30)]
        texts.append(rng.choice(["", " "]).join(parts[: rng.randint(1, 4)]))
    texts += [" ".join(rng.choices(words, k=40)) for _ in range(20)]
    assert found(spark, texts, length, bucket) == brute(texts, length)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    text = "".join(rng.choices("abcde ", k=9000))
    texts = [text + text[2000:4100] + "z" + text[500:899], text[3000:3399], text[8601:9000] + "q" + text[5000:5400]]
    assert found(spark, texts, 400, parts=2) == brute(texts, 400)


def test_a_common_passage_among_different_neighbours(spark):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=450))
    texts = ["".join(rng.choices("abcdefgh ", k=300)) + passage + "".join(rng.choices("abcdefgh ", k=300)) for _ in range(400)]
    assert found(spark, texts, 400, bucket=50, parts=8) == brute(texts, 400)


def test_one_bucket():
    rows = [(b"xab", b"cd", 0, 3, 1), (b"ab", b"cx", 0, 2, 1), (b"b", b"qq", 0, 1, 1), (b"zzz", b"yyy", 0, 3, 2)]
    strings = Counter((t, before[high - t :], after[: 3 - t]) for before, after, low, high, n in rows for t in range(low, high + 1) for _ in range(n))
    wanted = [sum(1 << t for t in range(low, high + 1) if strings[t, before[high - t :], after[: 3 - t]] > 1) for before, after, low, high, _ in rows]
    assert repeated_strings(rows, 4) == wanted


def test_results_are_made_in_slices(spark, monkeypatch):
    texts = [b"x" * n for n in (3, 9, 0, 30, 2)] + [None, b"y"]
    batch = pa.record_batch([pa.array(range(7)), pa.array(texts, pa.binary())], ["doc_id", "text"])
    monkeypatch.setattr(suffix_dedup, "SLICE", 10)
    parts = [part.to_pydict()["doc_id"] for part in suffix_dedup.slices(batch, 1)]
    assert parts == [[0, 1], [2, 3], [4, 5, 6]]
    assert [len(part) for part in suffix_dedup.slices(batch.slice(0, 0), 1)] == [0]
    rng = random.Random(10)
    texts = ["".join(rng.choices("abcd", k=60)) for _ in range(30)] + [None, ""]
    texts += [t and t[5:50] for t in texts]
    assert found(spark, texts, 12, parts=2) == brute(texts, 12)


@pytest.mark.parametrize("cast, name, back", [("string", "body", 5), ("binary", "body", 5), ("string", "kept", 4)])
def test_texts_travel_once(spark, cast, name, back):
    docs = spark.createDataFrame([(1, "12345678"), (2, "12345678"), (3, None)], "doc_id long, text string")
    rows = without_repeats(docs.select("doc_id", F.col("text").cast(cast).alias(name)), name, length=4)
    assert rows._jdf.queryExecution().analyzed().children().apply(0).output().size() == 2
    assert len(rows.columns) == back
    assert sorted((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in rows.collect()) == [(1, 8, b""), (2, 8, b""), (3, 0, b"")]


def test_odd_tables(spark, odd, none):
    assert without_repeats(none).collect() == []
    docs = odd.withColumn("spans", F.lit("old")).withColumn("bytes", F.lit("x")).withColumn("n", F.lit(1))
    rows = without_repeats(docs)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "bytes", "n", "n_bytes", "spans", "kept"]
    texts = [r["text"] for r in docs.collect()]
    key = lambda r: (str(r[0]), r[1:])
    wanted = sorted(((t, n, s, k) for t, (n, s, k) in zip(texts, brute(texts, 400))), key=key)
    got = [(r["text"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in rows.collect()]
    assert sorted(got, key=key) == wanted
