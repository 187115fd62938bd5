"""Byte strings that repeat anywhere, by suffix arrays of what may repeat.

Texts are read three times and never shuffled. A string of LENGTH bytes is represented by
one boundary inside it, a byte whose hash is the least of a window, chosen from that
string's bytes alone; so equal strings have equal boundaries at equal places, and share the
core around it. First, cores are counted. Second, texts emit the contexts of boundaries
whose core is not unique: the core's hash and the bytes before and after it, equal ones
counted instead of repeated. Contexts of one core form a bucket; the suffixes that start
before the core are sorted (suffix_groups), and a string repeats if it begins the next
suffix in order as well. Third, texts look their boundaries' contexts up and learn which of
their strings repeat.

A context is one symbol a byte up to the core, and one symbol, its place among the
bucket's, for the core and all that follows, so suffixes are compared to their ends. Buckets
of more than `bucket` different contexts (a passage among ever different neighbours) are
halved: strings that start far before the core share more bytes before it, the others more
bytes after it, so either half falls into smaller buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from millrace.llm.mapped_tables import MappedTable, mapped_table
from millrace.llm.suffix_groups import suffix_array
from millrace.sources.staging import stage

LENGTH = 400
WINDOW = 128  # most; two longs say which of its strings repeat
GRAM = 16
PIECE = 500_000  # bytes of a text that are held as arrays at once
BUCKET = 256  # different contexts of a core that one suffix array sorts
HELD = 40_000  # contexts that a task counts before it sends them
SLICE = 4_000_000  # bytes of texts whose results are held at once

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd
MIX = np.uint64(0xD6E8FEB86659FD93)
CONTEXT = "core_0 long, core_1 long, id_0 long, id_1 long, before binary, after binary, low int, high int"
SPANS = ArrayType(StructType().add("start", "long").add("end", "long"))
FLAGS = "id_0 long, id_1 long, bits_0 long, bits_1 long"


def inverse(odd: int) -> np.uint64:
    return np.uint64(pow(odd, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * MIX
    return h ^ h >> np.uint64(29)


@lru_cache(1)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, for 2^bits bytes."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(1 << bits, x, np.uint64))) for x in (BASE, inverse(int(BASE))))


class Rolling:
    """Hashes of the substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = powers(max(PIECE + LENGTH, n).bit_length())
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start, stop, length: int) -> np.ndarray:
        """Of substrings of one length whose starts are start to stop, or an array."""
        a = slice(start, stop) if isinstance(start, int) else start
        b = slice(start + length, stop + length) if isinstance(start, int) else start + length
        return mixed((self.sums[b] - self.sums[a]) * self.down[a])


def sliding(values: np.ndarray, width: int, f: np.ufunc, pad) -> np.ndarray:
    """f over every window of some values."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    table = np.full(rows * width, pad, values.dtype)
    table[: len(values)] = values
    table = table.reshape(rows, width)
    to, since = f.accumulate(table, axis=1).ravel(), f.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(since[:n], to[width - 1 : width - 1 + n])


class Shape:
    """How strings of some length are cut: core from `window` before the boundary on, `core` bytes long."""

    def __init__(self, length: int):
        if length < 4:
            raise ValueError("strings must have 4 bytes at least")
        self.length, self.gram = length, min(GRAM, length // 4)
        self.window = min(WINDOW, (length - self.gram) // 3)
        self.core = length - self.window + 1


def boundaries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, shape: Shape):
    """(boundary, low, high, core hash): strings from `high` to `low` bytes before the core are represented here.

    The string that starts at p is represented by the first boundary from p + window on.
    Whether a place up to p + 2 * window is one depends on fewer than 3 * window + gram
    bytes from p on, all inside the string; so texts need no mark between them.
    """
    w, n = shape.window, len(data) - shape.gram + 1
    none = np.zeros(0, np.int64)
    if n < 2 * w or not (ends - starts >= shape.length).any():
        return none, none, none, none
    rolling = Rolling(data)
    grams = (rolling.of(0, n, shape.gram) >> np.uint64(32)).astype(np.uint32)
    least = sliding(grams, w, np.minimum, np.uint32(0xFFFFFFFF))
    most = sliding(np.concatenate((np.zeros(w - 1, np.uint32), least, np.zeros(w - 1, np.uint32))), w, np.maximum, np.uint32(0))
    at = np.flatnonzero(most == grams)
    text = np.searchsorted(starts, at, "right") - 1
    before = np.concatenate(([-w], at[:-1]))
    high = np.minimum(np.minimum(at - w - starts[text], at - before - 1), w - 1)
    low = np.maximum(at - w - (ends[text] - shape.length), 0)
    use = low <= high
    at, low, high = at[use], low[use], high[use]
    return at, low, high, rolling.of(at - w, None, shape.core - w).view(np.int64)


def pieces(column: pa.Array, shape: Shape) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, row, place in the row's text) of pieces of texts, about PIECE bytes together.

    Pieces of a long text overlap, so that each of its strings is in one of them.
    """
    held, size = [], 0
    for row, text in enumerate(column):
        view = text.as_buffer() if text.is_valid else b""
        for start in range(0, max(len(view) - shape.length + 1, 0), PIECE):
            part = memoryview(view)[start : start + PIECE + shape.length - 1]
            held.append((part, row, start))
            size += len(part)
            if size >= PIECE:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts have about SLICE bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(sizes) - sizes
    edges = [0, *(np.flatnonzero(np.diff(before // SLICE)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def joined(held: list) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(part) for part, _, _ in held])
    starts = np.concatenate(([0], ends[:-1]))
    return b"".join(p for p, _, _ in held), starts, ends, *(np.array([h[i] for h in held]) for i in (1, 2))


def halves(digests: list[bytes]) -> np.ndarray:
    """128-bit hashes as two rows of longs."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T


def context_ids(data: bytes, at, low, high, shape: Shape) -> list[bytes]:
    """A hash of each context: its strings together, and which they are."""
    w, length = shape.window, shape.length
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    return [
        digest(bytes((a, b)) + view[q - w - b : q - w + length - a].tobytes())
        for q, a, b in zip(at.tolist(), low.tolist(), high.tolist())
    ]


def core_counts(texts: DataFrame, shape: Shape) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, ends, _, _ in pieces(batch.column(0), shape):
                *_, core = boundaries(np.frombuffer(data, np.uint8), starts, ends, shape)
                core, n = np.unique(core, return_counts=True)
                yield pa.record_batch([pa.array(core), pa.array(n)], ["core", "n"])

    return texts.mapInArrow(run, "core long, n long").groupBy("core").agg(F.sum("n").alias("n"))


def contexts(texts: DataFrame, repeated: MappedTable, shape: Shape) -> DataFrame:
    """The different contexts of repeated cores and how often each occurs."""
    w, length, core_end = shape.window, shape.length, shape.core - shape.window
    names = [part.split()[0] for part in CONTEXT.split(", ")] + ["n"]

    def table(held: dict) -> pa.RecordBatch:
        rows = list(held.values())
        core, own = halves([r[0] for r in rows]), halves(list(held))
        columns = [pa.array(x) for x in (*core, *own)]
        columns += [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.binary()), (2, pa.binary()), (3, pa.int32()), (4, pa.int32()), (5, pa.int64()))]
        return pa.record_batch(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        for batch in batches:
            for data, starts, ends, _, _ in pieces(batch.column(0), shape):
                at, low, high, cores = boundaries(np.frombuffer(data, np.uint8), starts, ends, shape)
                hit, _ = repeated.find(cores)
                at, low, high = at[hit], low[hit], high[hit]
                for key, q, a, b in zip(context_ids(data, at, low, high, shape), at.tolist(), low.tolist(), high.tolist()):
                    known = held.get(key)
                    if known:
                        known[5] += 1
                    else:
                        core = xxhash.xxh3_128_digest(data[q - w : q + core_end])
                        held[key] = [core, data[q - w - b : q - w], data[q + core_end : q - w + length - a], a, b, 1]
                if len(held) > HELD:
                    yield table(held)
                    held = {}
        if held:
            yield table(held)

    found = texts.mapInArrow(run, f"{CONTEXT}, n long")
    return found.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def repeated_strings(rows: list[tuple[bytes, bytes, int, int, int]], window: int) -> list[int]:
    """Which strings of each context (before, after, low, high, n) of a bucket repeat, as bits of how far before the core they start."""
    full = [(1 << high + 1) - (1 << low) if n > 1 else 0 for _, _, low, high, n in rows]
    if len(rows) == 1:
        return full
    place = {after: 256 + i for i, after in enumerate(sorted({r[1] for r in rows}))}
    symbols, owner, ahead = [], [], []
    for i, (before, after, _, high, _) in enumerate(rows):
        symbols += [*before, place[after]]
        owner += [i] * (high + 1)
        ahead += range(high, -1, -1)
    last = None
    for at in suffix_array(symbols):
        i, t = owner[at], ahead[at]
        before, after, low, high, _ = rows[i]
        if t < low:
            continue
        if last is not None:
            j, u = last
            if t == u and before[high - t :] == rows[j][0][rows[j][3] - t :] and after[: window - 1 - t] == rows[j][1][: window - 1 - t]:
                full[i] |= 1 << t
                full[j] |= 1 << t
        last = i, t
    return full


def as_longs(bits: list[int]) -> np.ndarray:
    return halves([b.to_bytes(16, "little") for b in bits])


def sorted_buckets(found: DataFrame, shape: Shape) -> DataFrame:
    """FLAGS of contexts, bucket by bucket; a bucket is small and lies in one partition."""
    names = ["id_0", "id_1", "bits_0", "bits_1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, ids, rows = None, [], []
        out_ids, out_bits = [], []

        def table() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out_ids)] + [pa.array(x) for x in as_longs(out_bits)]
            return pa.record_batch(columns, names)

        def close() -> None:
            for key, bits in zip(ids, repeated_strings(rows, shape.window)):
                if bits:
                    out_ids.append(key), out_bits.append(bits)

        for batch in batches:
            c = batch.to_pydict()
            for core_0, core_1, id_0, id_1, *row in zip(*(c[k] for k in ("core_0", "core_1", "id_0", "id_1", "before", "after", "low", "high", "n"))):
                if (core_0, core_1) != core:
                    close() if rows else None
                    core, ids, rows = (core_0, core_1), [], []
                ids.append((id_0, id_1)), rows.append(tuple(row))
            if len(out_ids) > HELD:
                yield table()
                out_ids, out_bits = [], []
        if rows:
            close()
        if out_ids:
            yield table()

    return found.repartition("core_0", "core_1").sortWithinPartitions("core_0", "core_1").mapInArrow(run, FLAGS)


def halved(work: DataFrame, window: int) -> DataFrame:
    """Contexts of too large buckets, their strings cut in two by how far before the core they start.

    Strings of one half share more bytes, those up to the nearest start and those up to the
    nearest end, and these make the new buckets. A context is at most two rows afterwards.
    """
    middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    ends = F.array(F.struct(F.col("first").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("last").alias("b")))
    ends = F.filter(ends, lambda e: F.greatest(F.col("low"), e["a"]) <= F.least(F.col("high"), e["b"]))
    rows = work.withColumn("half", F.explode(ends)).withColumns({"first": F.col("half.a"), "last": F.col("half.b")})
    rows = rows.withColumns({"to": F.least("high", "last"), "from": F.greatest("low", "first")})
    rows = rows.withColumns({
        "before": F.expr("substring(before, high - to + 1, to)"), "after": F.expr(f"substring(after, 1, {window - 1} - from)"),
    })
    shared = F.expr("substring(before, to - first + 1, first)"), F.expr(f"substring(after, 1, {window - 1} - last)")
    named = [F.hex("core_0"), F.hex("core_1"), F.hex("first"), F.hex("last"), *map(F.hex, shared)]
    rows = rows.withColumn("core", F.md5(F.concat_ws(":", *named)))
    long = lambda start: F.conv(F.substring("core", start, 16), 16, -10).cast("long")
    return rows.select(
        long(1).alias("core_0"), long(17).alias("core_1"), "id_0", "id_1", "before", "after",
        F.col("from").alias("low"), F.col("to").alias("high"), "n", "first", "last",
    )


def all_bits(word: int) -> Column:
    """The bits from column first to column last, as far as they are in a 64-bit word."""
    low, high = f"greatest(first - {64 * word}, 0)", f"least(last - {64 * word}, 63)"
    return F.expr(f"if({low} <= {high}, shiftleft(-1L, {low}) & shiftrightunsigned(-1L, 63 - {high}), 0L)").alias(f"bits_{word}")


def repeated_contexts(found: DataFrame, shape: Shape, bucket: int) -> DataFrame:
    """FLAGS of contexts. A bucket too large to sort is halved until its parts are not, or hold one string alone."""
    core, parts = ["core_0", "core_1"], []
    work = found.withColumns({"first": F.lit(0), "last": F.lit(shape.window - 1)})
    whole = (F.col("low") <= F.col("first")) & (F.col("high") >= F.col("last"))
    strings = F.md5(F.concat_ws(":", F.hex("before"), F.hex("after")))
    while True:
        sizes = work.groupBy(*core).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("n").alias("times"),
            (F.bool_and(whole) & (F.min(strings) == F.max(strings))).alias("same"),
        )
        large = stage(sizes.filter(F.col("rows") > bucket).select(*core, "same", "times"), "large")
        if large.isEmpty():
            parts.append(sorted_buckets(work, shape))
            break
        parts.append(sorted_buckets(work.join(large, core, "left_anti"), shape))
        alike = work.join(large.filter("same AND times > 1"), core, "left_semi")
        parts.append(alike.select("id_0", "id_1", all_bits(0), all_bits(1)))
        work = stage(halved(work.join(large.filter("NOT same"), core, "left_semi"), shape.window), "halves")
    flags = reduce(DataFrame.unionByName, parts)
    return flags.groupBy("id_0", "id_1").agg(*(F.bit_or(c).alias(c) for c in ("bits_0", "bits_1")))


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """All columns of docs, and n_bytes, spans (array of start, end in bytes) and kept (binary).

    Texts are UTF-8 bytes. Spans are the maximal runs of bytes covered by strings of
    `length` bytes that start at least twice in all texts, at places of one text or of
    several, overlapping or not; kept is the rest. A NULL or empty text has no bytes, a
    text shorter than `length` keeps all. Repeated rows are texts of their own and so
    repeat each other. An empty table gives no rows. Columns of docs that are called like
    one of the new ones are replaced.
    """
    shape = Shape(length)
    texts = docs.select(F.col(text).cast("binary").alias("text"))
    cores = core_counts(texts, shape).filter("n > 1").select("core")
    repeated = mapped_table(cores, "cores")
    found = stage(contexts(texts, repeated, shape), "contexts")
    flags = mapped_table(repeated_contexts(found, shape, bucket), "flags")

    new = ["n_bytes", "spans", "kept"]
    kept = [c for c in docs.columns if c not in new]
    # Texts that are among the kept columns travel once; others go last, under a name that none of those has.
    once = text in kept and docs.schema[text].dataType in (StringType(), BinaryType())
    source = kept.index(text) if once else len(kept)
    schema = StructType([f for f in docs.schema.fields if f.name in kept])
    schema = schema.add("n_bytes", "long").add("spans", SPANS).add("kept", "binary")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, source)):
            whole = batch.column(source)
            spans: list[list[tuple[int, int]]] = [[] for _ in range(len(batch))]
            for data, starts, ends, row, place in pieces(whole, shape):
                at, low, high, core = boundaries(np.frombuffer(data, np.uint8), starts, ends, shape)
                hit, _ = repeated.find(core)
                at, low, high = at[hit], low[hit], high[hit]
                if not len(at):
                    continue
                ids = halves(context_ids(data, at, low, high, shape))
                hit, (_, *bits) = flags.find(ids[0], ids[1:]) if flags.sizes else (np.zeros(len(at), bool), [0, 0, 0])
                for q, t in zip(at[hit].tolist(), bits_of(bits, hit)):
                    first = q - shape.window - t[::-1]
                    i = int(np.searchsorted(starts, first[0], "right")) - 1
                    gaps = np.flatnonzero(np.diff(first) > length) + 1
                    for run in np.split(first, gaps):
                        move = int(place[i] - starts[i])
                        spans[row[i]].append((int(run[0]) + move, int(run[-1]) + length + move))
            found = [merged(s) for s in spans]
            sizes, rest = [], []
            for value, some in zip(whole, found):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                sizes.append(len(data))
                rest.append(without(data, some))
            columns = [*batch.columns[: len(kept)], pa.array(sizes, pa.int64())]
            columns += [pa.array([[{"start": a, "end": b} for a, b in s] for s in found], pa.list_(span)), pa.array(rest, pa.binary())]
            yield pa.record_batch(columns, schema.names)

    own = [] if once else [F.col(text).cast("binary").alias("_".join(["bytes", *kept]))]
    return docs.select(*kept, *own).mapInArrow(run, schema)


def bits_of(longs: list[np.ndarray], hit: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the bits that are set in pairs of longs."""
    words = np.stack([x[hit] for x in longs], axis=1).astype("<i8")
    for row in np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little"):
        yield np.flatnonzero(row)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
