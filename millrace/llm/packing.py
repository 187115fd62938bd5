"""Best-fit packing of tokenised documents into sequences by linear grouping.

Tokens are counted where the texts are; only one small row for each piece of a document
goes on. Pieces are dealt evenly over shards of a fixed number of pieces, and a shard is
packed by itself: large lengths are sorted and cut into groups of equal size, each rounded
up to its longest member; sequences are composed of the few rounded sizes by bounded
knapsacks; documents take the places of the rounded sizes; small ones then go, longest
first, where they leave the least room.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.shared import tidy
from millrace.sources.staging import stage

LENGTH = 4096  # tokens of a sequence
END = 1  # the id that closes a document
SHARD = 16_384  # pieces packed together
SMALL = 4  # lengths below LENGTH / SMALL are small
GROUPS = 400
IDS = 1 << 16  # more than any id of a vocabulary that is cut here
REMEMBERED = 120_000  # words whose ids a worker keeps, and as many that it met before them

BREAKS = re.compile(r"[ \n\r\t]+")

# How a tokenizer of lower-case words cuts a text, as its file states it.
NORMAL = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Words of ASCII and Latin letters that NFC leaves alone, without the first character of
# added tokens, and their parts by that pattern once they are lower-case.
LATIN = re.compile("[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u017f]+|[0-9]|[^a-z\u00df-\u017f0-9]+")
LATIN_TEXT = re.compile(LATIN.pattern.replace("]+", " \n\r\t]*"))


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies use for each byte: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(others)}


class WordIds(dict):
    """Token ids of a word as little-endian 32-bit bytes.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those
    of its words one after the other. Where it cuts words by PATTERN, those of Latin letters
    are cut here and only their parts go to its vocabulary, a text of such words at once;
    all others go through it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model, self.letters = tokenizer.encode_batch_fast, tokenizer.model, byte_letters()
        self.cuts = cuts_latin_words(json.loads(tokenizer.to_str()))
        self.before: dict[str, bytes] = {}
        self.bytes = [struct.pack("<I", i) for i in range(IDS)] if self.cuts else []

    def of(self, text: str) -> bytes:
        if self.cuts and LATIN_TEXT.fullmatch(text):
            if len(self) > REMEMBERED:
                self.age()
            return b"".join(map(self.__getitem__, text.lower().split()))
        words = self.words(text)
        new = [word for word in set(words) if word not in self]
        if len(self) > REMEMBERED and new:
            self.age()
            new = list(set(words))
        whole = []
        for word in new:
            if self.cuts and LATIN.fullmatch(word):
                self[word] = self[word.lower()]
            else:
                whole.append(word)
        for a in range(0, len(whole), 10_000):
            some = whole[a : a + 10_000]
            for word, found in zip(some, self.encode(some, add_special_tokens=False)):
                self[word] = np.array(found.ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, words))

    def age(self) -> None:
        """Words met since the last time stay at hand, those before them go."""
        self.before = dict(self)
        self.clear()

    def words(self, text: str) -> list[str]:
        """split() knows the white space that PATTERN drops, and four controls that it keeps."""
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return text.split() if self.cuts and not odd else BREAKS.split(text)

    def __missing__(self, word: str) -> bytes:
        """Of a lower-case word of Latin letters; its parts are words as well."""
        if word in self.before:
            found = self[word] = self.before[word]
            return found
        parts = PARTS.findall(word)
        if len(parts) > 1:
            found = b"".join(map(self.__getitem__, parts))
        else:
            letters = word.encode().decode("latin-1").translate(self.letters)
            found = b"".join([self.bytes[token.id] for token in self.model.tokenize(letters)])
        self[word] = found
        return found


def cuts_latin_words(config: dict) -> bool:
    """Whether a tokenizer's file lower-cases texts and cuts them by PATTERN, and its added tokens begin with <."""
    normal, cut = config["normalizer"] or {}, config["pre_tokenizer"] or {}
    steps, cuts = normal.get("normalizers", []), cut.get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == NORMAL
        and steps[1]["pattern"] == {"Regex": r"\s+"}
        and steps[1]["content"] == " "
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": PATTERN}
        and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and max(config["model"]["vocab"].values()) < IDS
        and all(t["content"].startswith("<") and not t["normalized"] for t in config["added_tokens"])
    )


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker process, so that it meets a word once."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and END, cut only above length."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = ids.of(text or "") + end
                n = len(data) // 4
                for number, a in enumerate(range(0, n, length)):
                    part = data[4 * a : 4 * (a + length)]
                    row.append(i), piece.append(number), start.append(a)
                    size.append(len(part) // 4), crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, size, crc)]
            yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def composed(sizes: list[int], counts: list[int], length: int) -> Iterator[tuple[list[int], int]]:
    """(how many of each size, how often): sequences of rounded sizes, largest first, filled as full as can be."""
    left = list(counts)
    for first in range(len(sizes)):
        while left[first]:
            use = [0] * len(sizes)
            use[first] = 1
            room = length - sizes[first]
            # best[r]: the last (size, copies) of some multiset of sizes that sums to r
            reached, came = np.zeros(room + 1, bool), []
            reached[0] = True
            for k in range(first, len(sizes)):
                free = left[k] - use[k]
                copies, before = 0, reached
                while copies < free and (copies + 1) * sizes[k] <= room:
                    copies += 1
                    moved = np.zeros_like(reached)
                    moved[copies * sizes[k] :] = before[: room + 1 - copies * sizes[k]]
                    reached = reached | moved
                came.append((k, before, copies))
                if reached[room]:
                    break
            at = int(np.flatnonzero(reached)[-1])
            for k, before, copies in reversed(came):
                for n in range(copies + 1):
                    if at >= n * sizes[k] and before[at - n * sizes[k]]:
                        use[k] += n
                        at -= n * sizes[k]
                        break
            times = min(left[k] // n for k, n in enumerate(use) if n)
            left = [c - n * times for c, n in zip(left, use)]
            yield use, times


def packed(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    large = order[lengths[order] * SMALL >= length]
    small = order[len(large) :]
    bounds = np.linspace(0, len(large), min(GROUPS, len(large)) + 1).astype(int)
    members = [list(large[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = [int(lengths[m[0]]) for m in members]
    loads: list[int] = []
    for use, times in composed(sizes, [len(m) for m in members], length):
        for _ in range(times):
            load = 0
            for k, n in enumerate(use):
                for _ in range(n):
                    i = members[k].pop()
                    sequence[i], offset[i] = len(loads), load
                    load += int(lengths[i])
            loads.append(load)
    # Sequences by the room they have left; bit r of rooms is set if any has r left.
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for number, load in enumerate(loads):
        by_room.setdefault(length - load, []).append(number)
        rooms |= 1 << (length - load)
    for i in small:
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, number = length, len(loads)
            loads.append(0)
        sequence[i], offset[i] = number, loads[number]
        loads[number] += need
        by_room.setdefault(room - need, []).append(number)
        rooms |= 1 << (room - need)
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    A document is its text's ids and END; a NULL or empty text is END alone. Repeated rows
    are packed each, a NULL doc_id stays NULL, an empty table gives no rows, other columns
    are not read. Offsets of a sequence leave no gap; sequence numbers are arbitrary.
    """
    rows = stage(pieces(docs, tokenizer, length), "pieces")
    shards = max(1, -(-rows.count() // shard))
    spread = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        sequence, offset = packed(table["length"].to_numpy(), length)
        sequence = sequence + (table["shard"][0].as_py() << 32)
        table = table.drop_columns(["shard"])
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return spread.groupBy("shard").applyInArrow(run, f"{names}, sequence_id long, offset long")
