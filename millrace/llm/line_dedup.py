"""Line dedup by a segment-partition edit join.

A line is cut into one segment more than the edits allowed, so two lines within that
distance share a segment unchanged. Every line files its segments by length and number and
probes, for its own and each shorter length, the substrings that could be such a segment.
Map tasks send the hashes of both in packed arrays; a shard sorts them and yields the
lines that meet. Only those lines' texts are fetched, and a banded bit-parallel edit
distance decides. Lines too short to allow edits are copies only if they are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from millrace.llm.clusters import Sets, clusters, verified
from millrace.llm.graphs import components
from millrace.llm.hash_files import hash_set, rows_in
from millrace.llm.kneser_ney import shard_of
from millrace.llm.quality_rules import bound
from millrace.llm.shared import release, tidy
from millrace.sources.staging import stage

EDITS = 2
LEAST_CHARS = 1  # of a line that may be a copy; blank ones stay
EDIT_CHARS = 40  # shorter lines say something else after two edits, so they are copies only if equal
SHARD_BYTES = 24_000_000  # of text for each shard
BLOCK = 600_000  # entries packed at once
ENTRY = np.dtype([("key", "<u8"), ("line", "<i8"), ("filed", "u1")])


def probes(length: int, edits: int) -> list[tuple[int, int, int, int, bool]]:
    """(target length, segment number, start, end, filed) of the substrings of a line of that length.

    Of the substrings that could equal segment i of a shorter line only those are taken that
    leave room for i edits before it and edits - i after it; those of the line itself are filed.
    """
    out, parts = [], edits + 1
    for target in range(max(parts, length - edits), length + 1):
        more = length - target
        for i in range(parts):
            a, b = target * i // parts, target * (i + 1) // parts
            low = max(a - i, a + more - (edits - i), 0)
            high = min(a + i, a + more + (edits - i), length - (b - a))
            out += [(target, i, s, s + b - a, not more and s == a) for s in range(low, high + 1)]
    return out


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most edits.

    Bit k of state e says that the characters of a so far match as many of b, give or take
    k - edits, with at most e edits; the states are a band of 2 * edits + 1 bits.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << (j + edits)
    full = (1 << 2 * edits + 1) - 1
    state = [1 << edits]
    for e in range(edits):
        state.append((state[e] | state[e] << 1) & full)
    for i, c in enumerate(a):
        match = at.get(c, 0) >> i
        new = [state[0] & match]
        for e in range(1, edits + 1):
            new.append((state[e] & match | state[e - 1] | state[e - 1] >> 1 | new[e - 1] << 1) & full)
        state = new
        if not state[edits]:
            return False
    return bool(state[edits] >> (len(b) - len(a) + edits) & 1)


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at, line, line_hash) of the lines that are not blank."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return rows.filter((F.length("line") >= LEAST_CHARS) & has_words(F.col("line"))).withColumn("line_hash", line_hash(F.col("line")))


def has_words(line: Column) -> Column:
    """False for blank lines, which are never copies."""
    return F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    return F.xxhash64(line, F.length(line))


def meeting_lines(docs: DataFrame, edits: int, shards: int) -> DataFrame:
    """(bucket, node): line hashes that share a filed segment, two or more in each bucket."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, list] = {}
        seen: set[int] = set()
        keys, lines, filed = [], [], []

        def flush() -> pa.RecordBatch:
            entries = np.empty(len(keys), ENTRY)
            entries["key"], entries["line"], entries["filed"] = keys, lines, filed
            entries = entries[np.argsort(entries["key"], kind="stable")]
            found, start = np.unique(shard_of(entries["key"], shards), return_index=True)
            blobs = [packed(entries[a:b]) for a, b in zip(start, np.append(start[1:], len(entries)))]
            keys.clear(), lines.clear(), filed.clear()
            return pa.record_batch([pa.array(found.astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "data"])

        for batch in batches:
            for line, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                n = len(line)
                if n not in places:
                    places[n] = probes(n, edits)
                for target, i, a, b, own in places[n]:
                    keys.append(xxhash.xxh3_64_intdigest(line[a:b], target * 64 + i))
                    lines.append(node)
                    filed.append(own)
                if len(keys) >= BLOCK:
                    yield flush()
        if keys:
            yield flush()

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        entries = np.concatenate([unpacked(d) for d in frame["data"]])
        entries = entries[np.argsort(entries["key"], kind="stable")]
        key = entries["key"]
        same = key[1:] == key[:-1]
        entries = entries[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        order = np.lexsort((entries["line"], entries["key"]))
        entries = entries[order]
        fresh = np.ones(len(entries), bool)
        fresh[1:] = (entries["key"][1:] != entries["key"][:-1]) | (entries["line"][1:] != entries["line"][:-1])
        first = np.flatnonzero(fresh)
        own = np.maximum.reduceat(entries["filed"], first) if len(first) else entries["filed"]
        entries = entries[first]
        starts = np.flatnonzero(np.concatenate(([True], entries["key"][1:] != entries["key"][:-1]))) if len(first) else first
        size = np.diff(np.append(starts, len(entries)))
        good = (size > 1) & (np.add.reduceat(own, starts, dtype=np.int64) > 0) if len(first) else size > 1
        kept = entries[np.repeat(good, size)]
        del entries, key, same
        release()
        return pd.DataFrame({"bucket": kept["key"].view(np.int64) if len(kept) else [], "node": kept["line"]})

    rows = numbered_lines(docs).filter(F.length("line") >= EDIT_CHARS).select("line", "line_hash")
    packs = rows.mapInArrow(tidy(send), "shard int, data binary")
    return packs.groupBy("shard").applyInPandas(meet, "bucket long, node long")


def packed(entries: np.ndarray) -> bytes:
    """Column after column: keys as differences, which leaves their high bytes zero."""
    key = np.diff(entries["key"], prepend=np.uint64(0))
    parts = [key.view(np.uint8).reshape(-1, 8)[:, i] for i in range(8)]
    return np.int64(len(entries)).tobytes() + b"".join(
        np.ascontiguousarray(p).tobytes() for p in (*parts, entries["line"], entries["filed"])
    )


def unpacked(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    out = np.empty(n, ENTRY)
    key = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n, 8).reshape(8, n).T).view("<u8").reshape(-1)
    out["key"] = np.cumsum(key, dtype=np.uint64)
    out["line"] = np.frombuffer(blob, "<i8", n, 8 + 8 * n)
    out["filed"] = np.frombuffer(blob, np.uint8, n, 8 + 16 * n)
    return out


def character_counts(line: str) -> np.ndarray:
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(codes & 63, minlength=64).astype(np.int32)


def comparer(edits: int):
    """For `verified`: (a, b) links that join the same lines as all pairs within the distance."""
    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chunk", "ascending"), ("node", "ascending")])
        nodes, lines, chunk = (table[c].to_pylist() for c in ("node", "line", "chunk"))
        two, sets, out = chunk[0] != chunk[-1], Sets(len(nodes)), []
        # Characters by kind: an edit changes the counts by 2 at most, so most pairs end here.
        counts = np.array([character_counts(line) for line in lines])
        size, chunks = np.array([len(line) for line in lines]), np.array(chunk)
        for j, line in enumerate(lines):
            possible = np.abs(size[:j] - size[j]) <= edits
            if two:
                possible &= chunks[:j] != chunks[j]
            earlier = np.flatnonzero(possible)
            earlier = earlier[np.abs(counts[earlier] - counts[j]).sum(axis=1) <= 2 * edits]
            for i in earlier.tolist():
                # What is already joined needs no comparison.
                if sets.root(i) != sets.root(j) and within(lines[i], line, edits):
                    sets.join(i, j)
                    out.append((nodes[i], nodes[j]))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(node, class) of the line hashes that are within `edits` of another line, at one or more removes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-size // SHARD_BYTES))
    buckets = stage(meeting_lines(docs, edits, shards), "meeting")
    near = stage(clusters(buckets), "clusters")
    texts = numbered_lines(docs).select(F.col("line_hash").alias("node"), "line")
    lines = rows_in(texts, F.col("node"), hash_set(near.select("node"), "near-lines"))
    members = lines.join(near, "node").dropDuplicates(["node"]).withColumn("weight", F.length("line"))
    links = verified(members, comparer(edits), "a long, b long")
    return components(links)


def line_key(document: Column, at: Column) -> Column:
    return F.xxhash64(F.lit(0), document, at)


def first_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(key): line_key of the first line of every class; a line like no other is a class of its own.

    The first place is a partial aggregate, so a class that holds most lines is never gathered.
    """
    lines = stage(numbered_lines(docs).drop("line"), "lines")
    classes = line_classes(docs, edits).withColumnRenamed("node", "line_hash")
    near = lines.join(classes, "line_hash", "left").withColumn("class", F.coalesce("class", "line_hash"))
    firsts = near.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("first"))
    return firsts.select(line_key(F.xxhash64("first.doc_id", "first.text_hash"), F.col("first.at")).alias("key"))


def dedup_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """All columns of docs, text without its repeated lines, and n_lines, n_dropped.

    Of lines that equal one another or, from EDIT_CHARS characters on, are within `edits`
    character edits, directly or at more removes, the first in order of (doc_id, line)
    stays; so do all blank lines. NULL and empty texts stay as they are, with no line
    dropped; rows that repeat doc_id and text are one document and are treated alike; NULL
    ids come first. A text may be left empty. Columns of docs that share a name with the
    result's raise.
    """
    clash = {"n_lines", "n_dropped"} & set(docs.columns)
    if clash:
        raise ValueError(f"docs already has {sorted(clash)}")
    firsts, columns = hash_set(first_lines(docs, edits), "first-lines"), docs.columns
    place = columns.index("text")
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    document = F.xxhash64("doc_id", F.xxhash64("text"))
    # Blank lines have no key and stay.
    keys = bound(document, lambda d: F.transform(split, lambda line, i: F.when(has_words(line), line_key(d, i))))
    keyed = docs.select("*", keys.alias("_keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(len(columns))
            flat = keys.flatten()
            drop = flat.is_valid().to_numpy(zero_copy_only=False)
            drop[drop] = ~firsts.has(flat.drop_null().to_numpy())
            ends = np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False))
            texts, n_lines, n_dropped = batch.column(place).to_pylist(), [], []
            for i, (text, end) in enumerate(zip(texts, ends)):
                mine = drop[ends[i - 1] if i else 0 : end]
                n_lines.append(0 if text is None else len(mine))
                n_dropped.append(int(mine.sum()))
                if n_dropped[-1]:
                    texts[i] = "\n".join(line for line, gone in zip(text.split("\n"), mine) if not gone)
            out = list(batch.columns[:-1])
            out[place] = pa.array(texts, out[place].type)
            counts = [pa.array(n_lines, pa.int32()), pa.array(n_dropped, pa.int32())]
            yield pa.record_batch([*out, *counts], [*columns, "n_lines", "n_dropped"])

    schema = StructType(list(docs.schema.fields)).add("n_lines", "integer").add("n_dropped", "integer")
    return keyed.mapInArrow(tidy(run), schema)
