"""Interpolated modified Kneser-Ney bigram model, counted in Spark and mapped by workers.

Training sends packed arrays instead of rows: a map task counts the word pairs of a block
of texts and emits, for each shard of the pair hashes, one blob of distinct pairs; a shard
merges its blobs and writes its pairs as a sorted hash array. From the merged pairs the
statistics of each word (occurrences, followers, predecessors) go through a second, smaller
shuffle into sorted arrays of words. Sharding by the hash of the pair spreads the followers
of even the most common word. The driver sees one row of sums for each shard.

Scoring maps those arrays read-only, so that all workers of a host share one copy in the
page cache, and probes them shard by shard with sorted hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from millrace.llm.hash_files import HashSet, among
from millrace.llm.shared import mapped, release, save, shared_folder, tidy
from millrace.llm.words import END, START, WordHashes, mixed, texts_of

# Bytes of text that a shard stands for: every block of texts meets every shard, so beyond
# MANY shards of the small size they grow, up to the large one.
SHARD_BYTES, LARGE_SHARD_BYTES, MANY = 4_000_000, 16_000_000, 512
# Bytes of text that a task holds as arrays at once, and pairs that it merges at once.
TRAIN_BLOCK, SCORE_BLOCK, MERGE_ROWS = 12_000_000, 2_000_000, 500_000
TEXTS = 500  # texts of a batch that become Python objects at once

PAIR = np.dtype([("v", "<u8"), ("w", "<u8"), ("n", "<u4")])
STATS = np.dtype([("c", "<f8"), ("total", "<f8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4"), ("pred", "<u4")])
WORD = np.dtype([("key", "<u8"), *[(n, STATS[n]) for n in STATS.names]])
LOW = 6  # bytes of a word's hash that travel and are compared
MASK = np.uint64((1 << 8 * LOW) - 1)


@dataclass(frozen=True)
class Model:
    folder: str
    shards: int
    tokens: int  # N, training tokens
    words: int  # V, distinct training tokens
    pairs: int  # distinct training pairs
    singles: tuple[float, ...]  # words by number of predecessors: 1, 2, 3 or more
    low: tuple[float, float, float]  # discounts of predecessor counts
    high: tuple[float, float, float]  # discounts of pair counts
    written: dict[str, frozenset[int]]  # shards that have files of pairs, and of words


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more; fixed ones where too few are counted."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05 * (i + 1)), i + 1.0) for i, d in enumerate(found))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def shards_for(size: int) -> int:
    """Shards of a model of `size` bytes of text."""
    return max(4, min(-(-size // SHARD_BYTES), max(MANY, -(-size // LARGE_SHARD_BYTES))))


def low_bytes(values: np.ndarray) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW]


def from_low(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :LOW] = data
    return out.reshape(-1).view("<u8")


def packed_pairs(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    small = np.minimum(n, 255).astype(np.uint8)
    parts = low_bytes(v), low_bytes(w), small, n[small == 255].astype("<u4")
    return np.int64(len(v)).tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def size_of(blob: bytes) -> int:
    """Packed pairs."""
    return int(np.frombuffer(blob, np.int64, 1)[0])


def unpacked_pairs(blob: bytes, start: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs from start to end, all if not given."""
    k, at = size_of(blob), 8
    end = k if end is None else end
    v, w = (
        from_low(np.frombuffer(blob, np.uint8, (end - start) * LOW, at + (i * k + start) * LOW).reshape(-1, LOW))
        for i in (0, 1)
    )
    small = np.frombuffer(blob, np.uint8, end, at + 2 * k * LOW)
    n = small[start:].astype(np.uint32)
    large = n == 255
    if large.any():
        before = np.count_nonzero(small[:start] == 255)
        n[large] = np.frombuffer(blob, "<u4", before + np.count_nonzero(large), at + 2 * k * LOW + k)[before:]
    return v, w, n


def cuts_of(blob: bytes, first: int, parts: int, shards: int) -> np.ndarray:
    """Where each of `parts` of the shards begins, from the first on, in packed pairs sorted by key; and the end."""
    v, w, _ = unpacked_pairs(blob)
    return np.searchsorted(shard_of(mixed(v, w), shards), np.arange(first, first + parts + 1, dtype=np.uint64))


def blocks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; a longer text is a range of its own."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size + 1
    if start < len(sizes):
        yield start, len(sizes)


def pairs_of(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, word, where each text starts) of all tokens, each text closed by its end."""
    words, starts = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        starts[i] = len(words)
        words += text.lower().split()
        words.append(END)
    w = hashes.of(words) & MASK
    v = np.empty_like(w)
    v[1:], v[starts] = w[:-1], np.uint64(hashes[START]) & MASK
    return v, w, starts


def sorting(hashes: np.ndarray) -> np.ndarray:
    """What sorts spread hashes, equal ones in their order: sorted with their places in the low bits, faster than argsort."""
    n = len(hashes)
    if n < 2:
        return np.arange(n)
    low, mask = hashes.min(), np.uint64((1 << n.bit_length()) - 1)
    spare = 64 - int(hashes.max() - low).bit_length()  # bits in which none differ
    packed = hashes - low if spare == 64 else (hashes - low) << np.uint64(spare)
    packed &= ~mask
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    packed &= mask
    order = packed.view(np.int64)
    found = hashes[order]
    # Hashes that differ in the replaced bits alone may stand in the wrong order; among millions hardly any do.
    return np.argsort(hashes, kind="stable") if (found[1:] < found[:-1]).any() else order


def grouped(keys: np.ndarray, order: np.ndarray | slice) -> np.ndarray:
    """Where each run of equal keys starts in the given order."""
    k = keys[order]
    return np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)


def distinct(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct keys, sorted; the place of each key among them)."""
    first = grouped(keys, order)
    place = np.empty(len(order), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return keys[order[first]], place


def train(
    texts: DataFrame, text: str = "text", label: str = "model", block: int = TRAIN_BLOCK,
    key: Column | None = None, found: HashSet | None = None,
) -> Model:
    """The model of a column of texts (NULL is an empty text).

    block: bytes of text whose pairs a task counts at once. found: only rows whose key it
    holds are counted, looked up by the task that counts them.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    shards, folder = shards_for(size), shared_folder(spark, label)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held, held_bytes = [], 0

        def flush() -> pa.RecordBatch:
            v, w, _ = pairs_of(held, hashes)
            keys = mixed(v, w)
            order = sorting(keys)
            first = grouped(keys, order)
            n = np.diff(np.append(first, len(order)))
            at = order[first]
            v, w, owner = v[at], w[at], shard_of(keys[at], shards)
            found, start = np.unique(owner, return_index=True)
            ends = np.append(start[1:], len(at))
            blobs = [packed_pairs(v[a:b], w[a:b], n[a:b]) for a, b in zip(start, ends)]
            return pa.record_batch([pa.array(found.astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "data"])

        for batch in among(batches, found):
            for at in range(0, batch.num_rows, TEXTS):
                for value in texts_of(batch.column(0).slice(at, TEXTS)):
                    held.append(value)
                    held_bytes += len(value) + 1
                    if held_bytes >= block:
                        yield flush()
                        held, held_bytes = [], 0
        if held:
            yield flush()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        keys, small, large, words, totals = merged(list(frame["data"]), shard, shards)
        save(f"{folder}/pairs-{shard}.npy", keys)
        save(f"{folder}/counts-{shard}.npy", small)
        save(f"{folder}/large-{shard}.npy", large)
        del keys, small, large
        owner = shard_of(mixed(words["key"], words["key"]), shards)
        order = np.argsort(owner, kind="stable")
        words, owner = words[order], owner[order]
        found, start = np.unique(owner, return_index=True)
        ends = np.append(start[1:], len(words))
        rows = [(int(o), columnar(words[a:b])) for o, a, b in zip(found, start, ends)] + [(-1, np.append(totals, shard).tobytes())]
        del words, owner
        release()
        return pd.DataFrame(rows, columns=["shard", "data"])

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        if shard < 0:
            totals = np.array([np.frombuffer(d, np.float64) for d in frame["data"]])
            sums = np.append(totals[:, :5].sum(0), totals[:, 5])  # and the shards that they come from
        else:
            words = summed(np.concatenate([from_columnar(d) for d in frame["data"]]))
            save(f"{folder}/words-{shard}.npy", np.ascontiguousarray(words["key"]))
            stats = np.empty(len(words), STATS)
            for name in STATS.names:
                stats[name] = words[name]
            save(f"{folder}/stats-{shard}.npy", stats)
            known, pred = words["c"] > 0, words["pred"]
            sums = np.array([words["c"].sum(), known.sum(), pred.sum(dtype=np.float64), (pred >= 3).sum()]
                            + [(pred == i).sum() for i in (1, 2, 3, 4)], np.float64)
        return pd.DataFrame({"shard": [shard], "sums": [list(map(float, sums))]})

    sent = (
        texts.select(F.col(text), *([] if key is None else [key.alias("_key")]))
        .mapInArrow(tidy(count), "shard int, data binary")
        .groupBy("shard")
        .applyInPandas(merge, "shard int, data binary")
        .groupBy("shard")
        .applyInPandas(finish, "shard int, sums array<double>")
        .collect()
    )
    pairs = np.concatenate([np.zeros(5), *(r["sums"] for r in sent if r["shard"] < 0)])
    high, pair_shards = (pairs[5:10], pairs[10:]) if len(pairs) > 5 else (pairs, [])
    low = np.zeros(8) + sum(np.array(r["sums"]) for r in sent if r["shard"] >= 0)
    written = {"pairs": frozenset(map(int, pair_shards)), "words": frozenset(r["shard"] for r in sent if r["shard"] >= 0)}
    return Model(folder, shards, int(low[0]), int(low[1]), int(low[2]), (low[4], low[5], low[3]),
                 discounts(*low[4:]), discounts(*high[:4]), written)


def merged(
    blobs: list[bytes], shard: int, shards: int, rows: int = MERGE_ROWS,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all packed pairs of a shard, each blob sorted by key: sorted keys, counts up to 255, (places, counts) of
    those of 255 and more, WORD of their words, and the pairs of count 1, 2, 3, 4 and of any.

    One range of keys goes after the other, so that about `rows` are held as arrays at once.
    """
    parts = max(1, -(-sum(map(size_of, blobs)) // rows))
    cuts = [cuts_of(b, shard * parts, parts, shards * parts) if parts > 1 else (0, None) for b in blobs]
    found, totals, words, at = [], np.zeros(5), np.empty(0, WORD), 0
    for part in range(parts):
        v, w, n = map(np.concatenate, zip(*(unpacked_pairs(b, c[part], c[part + 1]) for b, c in zip(blobs, cuts))))
        if not len(n):
            continue
        keys = mixed(v, w)
        order = sorting(keys)
        first = grouped(keys, order)
        n = np.add.reduceat(n[order].astype(np.int64), first)
        order = order[first]
        v, w, keys = v[order], w[order], keys[order]
        small = np.minimum(n, 255).astype(np.uint8)
        large = np.flatnonzero(small == 255)
        found.append((keys, small, np.array([at + large, n[large]])))
        totals += [*((n == i).sum() for i in (1, 2, 3, 4)), len(n)]
        at += len(n)
        del order, first, keys
        stats = word_stats_of(v, w, n)
        words = summed(np.concatenate((words, stats))) if len(words) else stats
    keys, small, large = zip(*found)
    return np.concatenate(keys), np.concatenate(small), np.concatenate(large, axis=1), words, totals


def summed(stats: np.ndarray) -> np.ndarray:
    """One row for each key, sorted."""
    keys = np.ascontiguousarray(stats["key"])
    order = sorting(keys)
    first = grouped(keys, order)
    out = np.zeros(len(first), WORD)
    out["key"] = keys[order[first]]
    if len(first):
        for name in STATS.names:
            out[name] = np.add.reduceat(stats[name][order], first)
    return out


def word_stats_of(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One row for each word of distinct pairs (v, w) of count n; either side is sorted by itself, to hold little at once."""
    def side(keys: np.ndarray, columns: dict) -> tuple[np.ndarray, dict]:
        order = sorting(keys)
        first = grouped(keys, order)
        sums = {name: np.add.reduceat(of()[order], first, dtype=np.int64) for name, of in columns.items()}
        return keys[order[first]], sums

    sides = [
        side(v, {"total": lambda: n, "n1": lambda: n == 1, "n2": lambda: n == 2, "n3": lambda: n >= 3}),
        side(w, {"c": lambda: n, "pred": lambda: np.ones(len(n), np.uint8)}),
    ]
    found = np.concatenate((sides[0][0], sides[1][0]))
    found.sort()
    found = found[grouped(found, slice(None))]
    out = np.zeros(len(found), WORD)
    out["key"] = found
    for keys, sums in sides:
        at = np.searchsorted(found, keys)
        for name, values in sums.items():
            out[name][at] = values
    return out


def columnar(words: np.ndarray) -> bytes:
    """Column after column, which packs better than row after row."""
    parts = [low_bytes(words["key"])] + [words[n].astype("<f8" if WORD[n].kind == "f" else "<u4") for n in STATS.names]
    return np.int64(len(words)).tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def from_columnar(blob: bytes) -> np.ndarray:
    k, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
    out = np.zeros(k, WORD)
    out["key"] = from_low(np.frombuffer(blob, np.uint8, k * LOW, at).reshape(k, LOW))
    at += k * LOW
    for name in STATS.names:
        out[name] = np.frombuffer(blob, WORD[name], k, at)
        at += k * WORD[name].itemsize
    return out


class Scorer:
    """Looks pairs up in a model's mapped arrays."""

    def __init__(self, model: Model):
        self.m, self.hashes, self.open = model, WordHashes(), {}

    def part(self, name: str, shard: int, empty: np.ndarray) -> np.ndarray:
        """An array of a shard; one that was written and is missing is an error."""
        key = name, shard
        if key not in self.open:
            there = shard in self.m.written["words" if name in ("words", "stats") else "pairs"]
            self.open[key] = np.asarray(mapped(f"{self.m.folder}/{name}-{shard}.npy")) if there else empty
        return self.open[key]

    def found(self, name: str, hashes: np.ndarray, needles: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, which needles it holds, where) of distinct needles, by shards of their hashes; either sorted in its shard."""
        edges = np.searchsorted(shard_of(hashes, self.m.shards), np.arange(self.m.shards + 1, dtype=np.uint64)).tolist()
        for shard, (a, b) in enumerate(zip(edges, edges[1:])):
            if a == b:
                continue
            known = self.part(name, shard, np.empty(0, np.uint64))
            if len(known):
                at = np.minimum(np.searchsorted(known, needles[a:b]), len(known) - 1)
                hit = np.flatnonzero(known[at] == needles[a:b])
                yield shard, hit + a, at[hit]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        needles, place = distinct(keys, sorting(keys))
        counts = np.zeros(len(needles))
        for shard, mine, at in self.found("pairs", needles, needles):
            n = self.part("counts", shard, np.empty(0, np.uint8))[at].astype(np.float64)
            full = n == 255
            if full.any():
                places, large = self.part("large", shard, np.empty((2, 0), np.int64))
                n[full] = large[np.searchsorted(places, at[full])]
            counts[mine] = n
        return counts[place]

    def word_stats(self, words: np.ndarray) -> np.ndarray:
        """STATS of sorted distinct words."""
        out = np.zeros(len(words), STATS)
        hashes = mixed(words, words)
        order = np.argsort(shard_of(hashes, self.m.shards), kind="stable")
        for shard, mine, at in self.found("words", hashes[order], words[order]):
            out[order[mine]] = self.part("stats", shard, np.empty(0, STATS))[at]
        return out

    def __call__(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of some texts."""
        m = self.m
        v, w, starts = pairs_of(texts, self.hashes)
        both = np.append(w, v[:1])  # a text begins after START, which is no word
        words, place = distinct(both, sorting(both))
        pw, pv = place[:-1], np.empty(len(w), place.dtype)
        pv[1:], pv[starts] = pw[:-1], place[-1]
        stats, n = self.word_stats(words), self.pair_counts(mixed(v, w))
        del v, w, both, place
        pred, d = stats["pred"].astype(np.float64), (0.0, *m.low)
        mass = sum(a * b for a, b in zip(m.low, m.singles))
        each = (pred - np.take(d, np.minimum(pred, 3).astype(int))) / max(m.pairs, 1)
        lower = each + (mass / m.pairs if m.pairs else 1.0) / (m.words + 1)
        total, d = stats["total"], (0.0, *m.high)
        left = sum(a * stats[n] for a, n in zip(m.high, ("n1", "n2", "n3")))
        gamma = np.where(total > 0, left / np.maximum(total, 1), 1.0)
        higher = (n - np.take(d, np.minimum(n, 3).astype(int))) / np.maximum(total, 1)[pv]
        score = np.log10(higher + gamma[pv] * lower[pw])
        c = stats["c"]
        base = np.log10((c + 0.5) / (m.tokens + 0.5 * (m.words + 1)))[pw]
        tokens = np.diff(np.append(starts, len(pw)))
        return {"n_tokens": tokens, "n_known": np.add.reduceat((c > 0).astype(np.int64)[pw], starts),
                "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(score, starts)}


SCORES = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def scored(
    docs: DataFrame, model: Model, text: str = "text", names: Sequence[str] = tuple(SCORES),
    key: Column | None = None, found: HashSet | None = None, block: int = SCORE_BLOCK,
) -> DataFrame:
    """All columns of docs and the chosen scores, of the rows whose key is found if a set is given; nothing is shuffled.

    block: bytes of text that a task looks up at once; each block meets every shard of the model.
    """
    clash = set(names) & set(docs.columns)
    if clash:
        raise ValueError(f"docs already has {sorted(clash)}")
    place, columns = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in among(batches, found):
            sizes = pc.binary_length(batch.column(place).cast(pa.binary())).fill_null(0).to_pylist()
            for a, b in blocks(sizes, block):
                kept = batch.slice(a, b - a)
                scores = scorer(texts_of(kept.column(place)))
                extra = [pa.array(scores[n], SCORES[n]) for n in names]
                yield pa.record_batch([*kept.columns, *extra], [*columns, *names])

    schema = StructType(list(docs.schema.fields))
    for name in names:
        schema = schema.add(name, "long" if pa.types.is_integer(SCORES[name]) else "double")
    return (docs if key is None else docs.select("*", key.alias("_key"))).mapInArrow(tidy(run), schema)
