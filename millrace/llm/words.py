"""Words as 64-bit hashes, inside tasks.

A word is a run of characters other than space and the ASCII controls 9 to 13, which is
what bytes.split() yields; lower-casing touches A-Z alone, as bytes.lower() does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

# Words one task remembers before it starts afresh: bounds memory, changes no result.
REMEMBERED = 150_000

# What no word can be: the end of a text and the place before its first word.
END, START = b"\n", b""


class WordHashes(dict):
    """Hash of a word, computed at first sight."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; NULL is an empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One well spread hash of two, order included."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15F39CC060))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; a shorter text that has a word is one run."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        out = words[:1]
        for i in range(1, n):
            out = mixed(out, words[i : i + 1])
        return out
    out = words[: n - width + 1]
    for i in range(1, width):
        out = mixed(out, words[i : n - width + 1 + i])
    return out
