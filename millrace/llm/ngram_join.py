"""N-gram Jaccard join by MinHash banding, in place of an LSH forest.

Texts become sets of word shingles, sets become signatures, and a signature is cut into
TREES bands of values, each hashed whole. Documents that share a band are candidates; the
bands' length is the longest, up to LONGEST, at which a pair at the threshold shares one with
the target probability, computed once. Candidates are then compared exactly. Equal sets are
one node from the start, so copies of any number cost one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from millrace.llm.clusters import Sets, clusters, verified
from millrace.llm.graphs import components
from millrace.llm.words import WordHashes, mixed, shingle_hashes, texts_of
from millrace.llm.shared import tidy
from millrace.sources.staging import stage

WIDTH, THRESHOLD = 5, 0.8
TREES, LONGEST, RECALL = 20, 10, 0.999
BLOCK = 60_000  # shingles hashed at once


def recall(depth: int, threshold: float, trees: int = TREES) -> float:
    """Probability that a pair of that similarity shares a prefix of `depth` values in some trie."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_depth(threshold: float, target: float = RECALL, trees: int = TREES) -> int:
    depth = LONGEST
    while depth > 1 and recall(depth, threshold, trees) < target:
        depth -= 1
    return depth


def shingle_set(text: bytes, hashes: WordHashes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(hashes.of(text.lower().split()), width))


def node_of(shingles: np.ndarray) -> int:
    """One id for equal sets."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def prefixes(sets: list[np.ndarray], depth: int, trees: int) -> np.ndarray:
    """A row for each set (none empty): the hash of its path's first `depth` values in each trie."""
    rng = np.random.default_rng(7)
    odd = rng.integers(0, 1 << 63, (trees, depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    turn = rng.integers(0, 1 << 63, (trees, depth), dtype=np.uint64)
    out = np.empty((len(sets), trees), np.uint64)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= BLOCK):
            held += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : end - 1]], dtype=np.int64)))
        for t in range(trees):
            path = np.full(end - at, t, np.uint64)
            for d in range(depth):
                x = (flat ^ turn[t, d]) * odd[t, d]
                path = mixed(path, np.minimum.reduceat(x ^ (x >> np.uint64(31)), starts))
            out[at:end, t] = path
        at = end
    return out


def signatures(docs: DataFrame, width: int, depth: int, trees: int) -> DataFrame:
    """(doc_id, node, n, paths) of the texts that have a word."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a in range(0, len(texts), 1000):
                sets = [shingle_set(t, hashes, width) for t in texts[a : a + 1000]]
                rows = [i for i, s in enumerate(sets) if len(s)]
                sets = [sets[i] for i in rows]
                paths = prefixes(sets, depth, trees).view(np.int64) if sets else np.empty((0, trees), np.int64)
                yield pa.record_batch(
                    [batch.column(0).take(pa.array([a + i for i in rows], pa.int64())),
                     pa.array([node_of(s) for s in sets], pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(list(paths), pa.list_(pa.int64()))],
                    ["doc_id", "node", "n", "paths"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, node long, n long, paths array<long>")


def with_shingles(docs: DataFrame, width: int) -> DataFrame:
    """(class, node, copies, paths, weight, shingles) of docs joined with their nodes' rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, hashes, width) for t in texts_of(batch.column(0))]
            same = pa.array([node_of(s) == n for s, n in zip(sets, batch.column(2).to_pylist())], pa.bool_())
            data = pa.array([s.tobytes() for s in sets], pa.binary())
            size = pa.array([len(s) for s in sets], pa.int64())
            kept = pa.record_batch([*batch.columns[1:], size, data], names)
            yield kept.filter(same)

    names = ["class", "node", "copies", "paths", "weight", "shingles"]
    rows = docs.select("text", *names[:4])
    return rows.mapInArrow(tidy(run), "class long, node long, copies long, paths array<long>, weight long, shingles binary")


def comparer(threshold: float):
    """For `verified`: (node, root, links) of each member, links weighted by copies."""
    def compare(table: pa.Table) -> pa.Table:
        nodes, chunk = table["node"].to_numpy(), table["chunk"].to_numpy()
        copies = table["copies"].to_numpy()
        paths = np.array(table["paths"].to_pylist(), np.int64)
        sets = [np.frombuffer(d, np.uint64) for d in table["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        order = np.lexsort((nodes, chunk))
        rank = {int(i): r for r, i in enumerate(order)}
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        mark, links, groups = np.zeros(len(values), np.uint8), np.zeros(len(nodes), np.int64), Sets(len(nodes))
        two = chunk.min() != chunk.max()
        inside = np.arange(len(nodes))
        for r, i in enumerate(order):
            later = order[r + 1 :]
            if two:
                later = later[chunk[later] != chunk[i]]
            # Sizes alone bound the similarity.
            small, big = np.minimum(sizes[later], sizes[i]), np.maximum(sizes[later], sizes[i])
            later = later[(small >= threshold * big - 1e-9)]
            later = later[(paths[later] == paths[i]).any(axis=1)]
            if not len(later):
                continue
            mine = flat[starts[i] : starts[i] + sizes[i]]
            mark[mine] = 1
            picked = np.repeat(starts[later] - (np.cumsum(sizes[later]) - sizes[later]), sizes[later])
            picked += np.arange(len(picked))
            first = np.cumsum(sizes[later]) - sizes[later]
            common = np.add.reduceat(mark[flat[picked]], first, dtype=np.int64)
            mark[mine] = 0
            near = later[common >= threshold * (sizes[later] + sizes[i] - common) - 1e-9]
            links[i] += copies[near].sum()
            links[near] += copies[i]
            for j in near:
                groups.join(r, rank[int(j)])
        roots = nodes[order[[groups.root(rank[int(i)]) for i in inside]]]
        return pa.table({"node": nodes, "root": roots, "links": links})

    return compare


def jaccard_classes(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each row of docs.

    Two texts are linked if their sets of `width`-word shingles (lower-case words; a shorter
    text is one shingle) have a Jaccard similarity of at least threshold. class_id is the
    least doc_id of those reachable by links, n_links the number of other rows linked to
    this one, copies included. Texts without words, NULL ones too, have no links and are
    classes of their own; a NULL doc_id is a class of its own (NULL) without links. Rows
    that repeat a doc_id are copies of each other. Empty tables give no rows; other columns
    are not read.
    """
    depth = prefix_depth(threshold)
    rows = docs.select("doc_id", "text")
    known = rows.filter(F.col("doc_id").isNotNull())
    signed = stage(signatures(known, width, depth, TREES), "signatures")
    nodes = stage(
        signed.groupBy("node").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("paths").alias("paths")
        ),
        "nodes",
    )
    buckets = nodes.select("node", F.explode("paths").alias("bucket"))
    near = stage(clusters(buckets), "clusters")
    wanted = near.join(nodes, "node").select(F.col("first_id").alias("doc_id"), "class", "node", "copies", "paths")
    members = with_shingles(known.join(wanted, "doc_id"), width).dropDuplicates(["node"])
    found = stage(verified(members, comparer(threshold), "node long, root long, links long"), "links")
    classes = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
    linked = nodes.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(
        classes, "node", "left"
    )
    linked = linked.withColumn("class", F.coalesce("class", "node")).drop("paths")
    least = linked.groupBy("class").agg(F.min("first_id").alias("class_id"))
    total = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
    by_node = linked.join(least, "class").select("node", "class_id", total)
    matched = signed.select("doc_id", "node").join(by_node, "node").select("doc_id", "class_id", "n_links")
    has_word = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    alone = rows.filter(F.col("doc_id").isNull() | ~has_word)
    return matched.unionByName(
        alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, that of the least doc_id; texts without words stay.

    Rows are judged by themselves: those of one doc_id with other texts need not share a
    verdict, of rows that repeat doc_id and text one stays, and rows with NULL ids are searched like
    others, after those with ids.
    """
    row = F.xxhash64("doc_id", "text")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row.alias("row"))
    keys = docs.select(key.alias("doc_id"), "text")
    found = jaccard_classes(keys)
    # A row's mark is 0 if it is a copy of another, 1 if only of rows that equal it.
    marks = found.groupBy(F.col("doc_id.row").alias("_row")).agg(
        F.max(F.col("doc_id.row") != F.col("class_id.row")).alias("_copy"), F.max("n_links").alias("_links")
    )
    marks = stage(
        marks.filter(F.col("_copy") | (F.col("_links") > 0)).select("_row", F.when(F.col("_copy"), 0).otherwise(1).alias("_mark")),
        "marks",
    )
    marked = docs.withColumn("_row", row).join(marks, "_row", "left")
    once = marked.filter("_mark = 1").dropDuplicates(["_row"])
    return marked.filter("_mark IS NULL").unionByName(once).select(docs.columns)
