"""Alignment of two tokenizers over the same texts, by sparse products.

Tokens of either kind are rows of an incidence matrix over the bytes they cover. The rows
of A B^T, accumulated one by one (Gustavson), are the overlap links; where two neighbouring
rows share no column, tokens of both kinds end, and a group ends. Incidence of tokens and
groups, multiplied in the same way, gives the links of tokens that share a group.

Both kinds of tokens always end where a space or line feed follows other text, so a text is
the sequence of its units, cut there, and a unit is encoded and multiplied once in a block.
A block of texts keeps one dictionary of its id pairs; only dictionaries are shuffled by
pair to count documents, so a pair that all documents hold is one row a block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millrace.sources.staging import stage

BLOCK = 2_000_000  # characters of text that share a dictionary
BATCH = 200_000  # characters, or products, that are held as arrays at once
REMEMBERED = 100_000  # units that a worker keeps before it starts afresh

SPACE = "▁"  # how pieces write a space
# White space in the widest sense, its run before other characters, and what follows up to
# a space or line feed after them.
WHOLE = re.compile(".+", re.DOTALL)
UNIT = re.compile(rf"[\s{SPACE}]*[^\s{SPACE}]+(?:(?![ \n])[\s{SPACE}]+[^\s{SPACE}]*)*|[\s{SPACE}]+")
BYTE = re.compile("<0x([0-9A-F]{2})>")
# Fixed value: how byte-level vocabularies cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Matrix = tuple[np.ndarray, np.ndarray, np.ndarray]  # CSR: where rows start and end, columns, values


def incidence(rows: np.ndarray, columns: np.ndarray, n_rows: int, values: np.ndarray | None = None) -> Matrix:
    """A matrix from entries whose rows ascend."""
    starts = np.zeros(n_rows + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=n_rows), out=starts[1:])
    return starts, columns, np.ones(len(columns), np.int64) if values is None else values


def products(a: Matrix, b: Matrix, most: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, values) of A B, sorted, some rows of A at a time.

    Row i is the sum of the rows of B that row i of A names. Rows are taken together as
    long as they name at most `most` entries of B; one row may name more.
    """
    starts, middle, values = a
    n = b[0][middle + 1] - b[0][middle]
    reach = np.concatenate(([0], np.cumsum(n)))[starts]
    first, last = 0, len(starts) - 1
    while first < last:
        after = max(first + 1, int(np.searchsorted(reach, reach[first] + most, "right")) - 1)
        entries = slice(starts[first], starts[after])
        k, used = middle[entries], n[entries]
        at = np.repeat(b[0][k] - (np.cumsum(used) - used), used) + np.arange(used.sum())
        rows = np.repeat(np.repeat(np.arange(first, after), np.diff(starts[first : after + 1])), used)
        columns, found = b[1][at], np.repeat(values[entries], used) * b[2][at]
        if len(rows):
            yield summed(rows, columns, found)
        first = after


def summed(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of one place added up, in order of rows and columns."""
    width = int(columns.max()) + 1
    if width < 1 << 62 - int(rows.max()).bit_length():
        place = rows * width + columns
    else:
        place = np.unique(np.array([rows, columns]), axis=1, return_inverse=True)[1].ravel()
    if (place[1:] < place[:-1]).any():
        order = np.argsort(place)
        rows, columns, values, place = rows[order], columns[order], values[order], place[order]
    at = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return rows[at], columns[at], np.add.reduceat(values, at)


def groups_of(a_length: np.ndarray, b_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each A token, of each B token), from their bytes alone; both cover the same bytes."""
    n = int(a_length.sum())
    a_bytes = incidence(np.repeat(np.arange(len(a_length)), a_length), np.arange(n), len(a_length))
    b_bytes = incidence(np.arange(n), np.repeat(np.arange(len(b_length)), b_length), n)
    a_group, b_group = np.zeros(len(a_length), np.int64), np.zeros(len(b_length), np.int64)
    group, last_column = -1, -1
    for rows, columns, _ in products(a_bytes, b_bytes):
        first = np.concatenate(([True], rows[1:] != rows[:-1]))
        apart = first & (np.concatenate(([last_column], columns[:-1])) != columns)
        number = group + np.cumsum(apart)
        a_group[rows], b_group[columns] = number, number
        group, last_column = int(number[-1]), int(columns[-1])
    return a_group, b_group


def shared_links(a_ids, a_group, b_ids, b_group, n_groups: int):
    """(group, a id, b id, links) for all pairs of ids in a group: token pairs are counted, not listed."""
    def counted(ids: np.ndarray, group: np.ndarray):
        found, n = np.unique(group << 32 | ids, return_counts=True)
        return found >> 32, found & 0xFFFFFFFF, n

    (ga, a, na), (gb, b, nb) = counted(a_ids, a_group), counted(b_ids, b_group)
    tokens = incidence(np.arange(len(ga)), ga, len(ga), na)
    by_group = incidence(gb, np.arange(len(gb)), n_groups, nb)
    for rows, columns, links in products(tokens, by_group):
        yield ga[rows], a[rows], b[columns], links


class Tokenizers:
    """Token ids of units by both tokenizers, and the bytes of every id."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece

        with open(bytes_path, encoding="utf-8") as file:
            config = json.load(file)
        self.a_bytes = byte_level_tokens(config["model"]["vocab"])
        self.a = byte_level_encoder(config, self.a_bytes) or any_encoder(bytes_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [self.piece_bytes(i, piece) for i, piece in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        # How ids are written before another of their kind, and as the last of a group or a unit.
        ends = (self.a_bytes, ","), (self.a_bytes, "|"), (self.b_bytes, ","), (self.b_bytes, ";"), (self.b_bytes, "\n")
        self.written = [f"{i}{end}" for ids, end in ends for i in range(len(ids))]
        self.mark = self.b.encode("\n")
        # No piece may hold a line feed, or a space after something else.
        joins = any("\n" in p or " " in p or SPACE in p.lstrip(SPACE) for p in pieces)
        self.cut = WHOLE if joins or len(self.mark) != 2 else UNIT

    def piece_bytes(self, i: int, piece: str) -> bytes:
        byte = BYTE.fullmatch(piece) if self.b.is_byte(i) else None
        return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode()

    def units(self, text: str) -> list[str]:
        return self.cut.findall(" " + text)

    def ids(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        if self.cut is WHOLE:
            return self.a(units), self.b.encode([u[1:] for u in units], num_threads=1)
        # After a line feed a unit is encoded as inside a text.
        b = self.b.encode(["\n" + u for u in units], num_threads=1)
        return self.a(units), [x[len(self.mark) :] for x in b]


def byte_level_encoder(config: dict, tokens: list[bytes]):
    """Ids by the ranks of a vocabulary whose merges are in order of their ids; None for another kind of tokenizer."""
    import tiktoken

    model, cut = config["model"], config["pre_tokenizer"] or {}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"]["".join(pair)] for pair in pairs]
    plain = (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
    if not plain or config["normalizer"] or model.get("dropout") or any(a >= b for a, b in zip(made, made[1:])):
        return None
    added = {t["id"] for t in config["added_tokens"]}
    ranks = {token: i for i, token in enumerate(tokens) if i not in added}
    encode = tiktoken.Encoding("units", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda units: list(map(encode, units))


def any_encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda units: [x.ids for x in tokenizer.encode_batch_fast(units, add_special_tokens=False)]


def byte_level_tokens(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id: a character stands for its own byte if that prints, else for the next other one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    byte = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


@lru_cache(1)
def tokenizers(bytes_path: str, pieces_path: str) -> Tokenizers:
    """One for all tasks of a worker process."""
    return Tokenizers(bytes_path, pieces_path)


class Units(dict):
    """Numbers of the units met so far; learn() aligns the new ones."""

    def __init__(self, both: Tokenizers):
        self.both, self.new = both, []
        self.sizes = np.zeros((0, 5), np.int64)  # A tokens, B tokens, groups, links, whether a tokenizer changes it
        self.groups: list[str] = []
        self.starts, self.pairs, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        return number

    def learn(self) -> None:
        at, size = 0, 0
        for i, unit in enumerate(self.new):
            size += len(unit)
            if size >= BATCH or i + 1 == len(self.new):
                self.align(self.new[at : i + 1])
                at, size = i + 1, 0
        self.new = []

    def align(self, units: list[str]) -> None:
        both = self.both
        a, b = both.ids(units)
        sizes = np.zeros((len(units), 5), np.int64)
        whole = "".join(units).encode()
        if any(self.joined(k, x) != whole for k, x in ((both.a_bytes, a), (both.b_bytes, b))):
            for i, unit in enumerate(units):
                if any(self.joined(k, x[i : i + 1]) != unit.encode() for k, x in ((both.a_bytes, a), (both.b_bytes, b))):
                    sizes[i, 4], a[i], b[i] = 1, [], []
        sizes[:, 0], sizes[:, 1] = list(map(len, a)), list(map(len, b))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        a_group, b_group = groups_of(both.a_size[a_ids], both.b_size[b_ids])
        n_groups = int(a_group[-1]) + 1 if len(a_group) else 0
        unit_of = np.zeros(n_groups, np.int64)
        unit_of[a_group] = np.repeat(np.arange(len(units)), sizes[:, 0])
        sizes[:, 2] = np.bincount(unit_of, minlength=len(units))
        self.groups += self.as_text(a_ids, a_group, b_ids, b_group, unit_of, sizes[:, 0] > 0)
        found = [np.zeros((3, 0), np.int64)]
        for group, x, y, links in shared_links(a_ids, a_group, b_ids, b_group, n_groups):
            found.append(np.array([unit_of[group], x << 32 | y, links]))
        unit, pair, links = np.concatenate(found, axis=1)
        if len(unit):
            codes, number = np.unique(pair, return_inverse=True)
            unit, number, links = summed(unit, number, links)
            pair = codes[number]
        sizes[:, 3] = np.bincount(unit, links, len(units)).astype(np.int64)
        ends = self.starts[-1] + np.cumsum(np.bincount(unit, minlength=len(units)))
        self.sizes, self.starts = np.concatenate((self.sizes, sizes)), np.concatenate((self.starts, ends))
        self.pairs, self.links = np.concatenate((self.pairs, pair)), np.concatenate((self.links, links))

    @staticmethod
    def joined(known: list[bytes], ids: list[list[int]]) -> bytes:
        return b"".join(map(known.__getitem__, chain.from_iterable(ids)))

    def as_text(self, a_ids, a_group, b_ids, b_group, unit_of: np.ndarray, used: np.ndarray) -> list[str]:
        """The groups of each unit as text: a1,a2|b1;a3|b2,b3."""
        out = np.full(len(used), "", object)
        if len(a_ids) == 0:
            return out.tolist()
        n_a, n_b = len(self.both.a_bytes), len(self.both.b_bytes)
        a_last = np.append(a_group[1:] != a_group[:-1], True)
        b_last = np.append(b_group[1:] != b_group[:-1], True)
        closes = np.append(unit_of[1:] != unit_of[:-1], True)[b_group] & b_last
        # A token's place: behind all of its kind before it, and the other kind's of groups before its own (B: and of its own).
        a_place = np.arange(len(a_ids)) + np.searchsorted(b_group, a_group, "left")
        b_place = np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, "right")
        codes = np.empty(len(a_ids) + len(b_ids), np.int64)
        codes[a_place] = a_ids + n_a * a_last
        codes[b_place] = b_ids + 2 * n_a + n_b * (b_last.astype(np.int64) + closes)
        text = "".join(map(self.both.written.__getitem__, codes.tolist()))
        out[used] = text.split("\n")[:-1]
        return out.tolist()


FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LOCAL = "block long, at binary, links binary, a array<int>, b array<int>, docs array<int>"


def aligned_block(texts: list[str | None], units: Units, detail: bool):
    """(columns of FOUND, groups, pairs and links of each text, dictionary) of a block."""
    numbers = [np.array(list(map(units.__getitem__, units.both.units(text) if text else [])), np.int32) for text in texts]
    units.learn()
    flat = np.concatenate(numbers)
    doc = np.repeat(np.arange(len(texts)), list(map(len, numbers)))
    # A text that a tokenizer changes has no tokens. Units change by themselves.
    bad = np.bincount(doc, units.sizes[flat, 4], len(texts)) > 0
    flat, doc = flat[~bad[doc]], doc[~bad[doc]]
    sums = [np.bincount(doc, units.sizes[flat, k], len(texts)).astype(np.int64) for k in range(4)]
    groups, digests = [], []
    for some, b in zip(numbers, bad):
        text = "" if b else ";".join(map(units.groups.__getitem__, some.tolist()))
        digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        groups += [text] * detail
    key, n = np.unique(doc * len(units) + flat, return_counts=True)
    doc, unit = (key // len(units), key % len(units)) if len(units) else (key, key)
    size = units.starts[unit + 1] - units.starts[unit]
    at = np.repeat(units.starts[unit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    codes, number = np.unique(units.pairs[at], return_inverse=True)
    doc, links = np.repeat(doc, size), np.repeat(n, size) * units.links[at]
    if len(doc):
        doc, number, links = summed(doc, number, links)
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    lists = [pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:])]) for x in (number.astype("<i4"), links.astype("<i8"))]
    words = codes >> 32, codes & 0xFFFFFFFF, np.bincount(number, minlength=len(codes))
    found = [*(pa.array(s) for s in sums), pa.array(digests)]
    return found, pa.array(groups) if detail else None, lists, words


def local_alignments(docs: DataFrame, id: str, bytes_path: str, pieces_path: str, detail: bool) -> DataFrame:
    """A row for each document and one for each block's dictionary, which alone has `a`."""
    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, {FOUND}, {LOCAL}" + ", groups string" * detail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(bytes_path, pieces_path)
        units, block = Units(both), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal units, block
            if len(units) > REMEMBERED:
                units = Units(both)
            found, groups, lists, words = aligned_block(texts, units, detail)
            n = len(texts)
            names = [part.split()[0] for part in schema.split(", ")]
            rows = [pa.array(ids, id_type), *found, pa.array([block] * n, pa.int64()), *lists]
            rows += [pa.nulls(n, pa.list_(pa.int32()))] * 3 + [groups] * detail
            yield pa.record_batch(rows, names)
            word = [pa.nulls(1, id_type), *(pa.nulls(1, c.type) for c in found), pa.array([block], pa.int64())]
            word += [pa.nulls(1, c.type) for c in lists]
            word += [pa.ListArray.from_arrays([0, len(w)], pa.array(w, pa.int32())) for w in words]
            yield pa.record_batch(word + [pa.nulls(1, pa.string())] * detail, names)
            block += 1

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i), texts.append(text)
                size += len(text or "")
                if size >= BLOCK:
                    yield from flush()
                    ids, texts, size = [], [], 0
        if texts:
            yield from flush()

    return docs.select(id, "text").mapInArrow(run, schema)


def align(docs: DataFrame, bytes_path: str, pieces_path: str, id: str = "doc_id", detail: bool = False) -> DataFrame:
    """One row for each document: its id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    Space and text by a byte-level tokenizer (A), the text by a piece model that adds the
    space (B). Groups are cut where tokens of both end; links are all A-B token pairs of a
    group. The count of an id pair is the number of documents that hold it linked; n_best
    are links whose count is the highest of their A id, count_sum is taken over links.
    With detail, groups (`a1,a2|b1;...`) and links (array of a, b, links, count) are added.

    NULL and empty texts, and those that a tokenizer changes, have zeros and ''. Repeated
    rows are documents of their own, a NULL id stays NULL, an empty table gives no rows,
    columns besides the id and `text` are not read.
    """
    kind = docs.schema[id].dataType.simpleString()
    local = stage(local_alignments(docs, id, bytes_path, pieces_path, detail), "alignment")
    zipped = F.posexplode(F.arrays_zip("a", "b", "docs")).alias("at", "pair")
    words = local.filter(F.col("a").isNotNull()).select("block", zipped).select("block", "at", "pair.*")
    counts = stage(words.groupBy("a", "b").agg(F.sum("docs").alias("count")), "pairs")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    judged = counts.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("best")).alias("best"))
    looked = words.join(judged, ["a", "b"]).select("block", "at", "a", "b", "count", "best")
    out = f"{id} {kind}, {FOUND}, n_best long, count_sum long"
    if detail:
        out += ", groups string, links array<struct<a:int,b:int,links:long,count:long>>"

    def close(docs: pa.Table, words: pa.Table) -> pa.Table:
        if words.num_rows:
            words = words.sort_by("at")
        count, best = words["count"].to_numpy(), words["best"].to_numpy()
        at, n = (np.frombuffer(b"".join(docs[c].to_pylist()), kind) for c, kind in (("at", "<i4"), ("links", "<i8")))
        size = pc.binary_length(docs["at"]).to_numpy() // 4
        edges, doc = np.append(0, np.cumsum(size)), np.repeat(np.arange(len(size)), size)
        columns = [docs["id"], *(docs[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"))]
        for some in (n * best[at], n * count[at]):
            total = np.zeros(docs.num_rows, np.int64)
            np.add.at(total, doc, some)
            columns.append(pa.array(total))
        if detail:
            pairs = [words["a"].to_numpy()[at], words["b"].to_numpy()[at], n, count[at]]
            pairs = pa.StructArray.from_arrays([pa.array(p) for p in pairs], ["a", "b", "links", "count"])
            columns += [docs["groups"], pa.ListArray.from_arrays(edges.astype(np.int32), pairs)]
        return pa.table(columns, names)

    names = [part.split()[0] for part in out.split(", ")]
    documents = local.filter(F.col("a").isNull()).drop("a", "b", "docs").withColumnRenamed("block", "own")
    return documents.groupBy("own").cogroup(looked.groupBy("block")).applyInArrow(close, out)
