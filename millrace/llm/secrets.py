"""Secret scans: fixed patterns, and stretches of characters that look random.

Two character Markov models are trained from the corpus itself: the values that the fixed
patterns find are the labelled random strings, all other text the ordinary one. A stretch
of identifier characters is a secret if the random model explains it clearly better. The
ordinary model is trained twice: the second time without the stretches that the first one
takes for secrets, so that unlabelled secrets do not teach it what is ordinary.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from millrace.sources.staging import stage

# Fixed patterns, and the least characters of a match (of its value for the first).
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

# Runs that the models look into: their characters and least length, which is also that of
# a random stretch. Log-likelihood ratios are natural logarithms: in all, for each transition
# of a word, and at most for one, so that no few odd transitions make a secret.
RUN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RUN = 16
RUN = re.compile(rf"[{re.escape(RUN_CHARS)}]{{{LEAST_RUN},}}")
WORD, LONG = re.compile("[A-Za-z0-9]+"), re.compile(f"[A-Za-z0-9]{{{LEAST_RUN},}}")
LEAST_RATIO, LEAST_EACH, CLIP = 12.0, 0.6, 3.0
WEIGHT = 8.0  # pseudo-counts of single characters after each character
EVEN = 0.5  # share of the random model in which letters and digits are equally likely
SHOUTED = 0.05  # share of ordinary letters that count as if names were made of them

SYMBOLS = len(RUN_CHARS) + 1  # the characters and the border of a run
CODE = np.full(256, SYMBOLS - 1, np.int64)
CODE[np.frombuffer(RUN_CHARS.encode(), np.uint8)] = np.arange(SYMBOLS - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns in order of start, then kind."""
    spans = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= LEAST_VALUE]
    spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], s[0]))


def values(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The random part of each span: an assignment's value, else all of it."""
    return [ASSIGN.match(text, a).group(1) if kind == 0 else text[a:b] for kind, a, b in spans]


def transitions(codes: np.ndarray) -> np.ndarray:
    """Counts of neighbouring codes, as one row of SYMBOLS x SYMBOLS."""
    return np.bincount(codes[:-1] * SYMBOLS + codes[1:], minlength=SYMBOLS * SYMBOLS) if len(codes) > 1 else 0


def coded(texts: list[str]) -> np.ndarray:
    data = ("\n" + "\n".join(texts) + "\n").encode()
    return CODE[np.frombuffer(data, np.uint8)]


def texts_in(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def observed(docs: DataFrame, text: str) -> DataFrame:
    """(cell, n, word, labelled): transitions of ordinary text, and the words that may be secrets.

    Those are the labelled ones and all of LEAST_RUN characters; they come once each
    however often they occur, so a secret that many texts hold is as rare as one that a
    single text holds. All other text is counted where it is; tasks send sums for at most
    SYMBOLS^2 transitions.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            labelled, long = set(), set()
            texts = texts_in(batch.column(0))
            for k in range(0, len(texts), 500):
                some = texts[k : k + 500]
                parts = [p for t in some for v in values(t, base_spans(t)) for p in WORD.findall(v)]
                other = [w for t in some for w in LONG.findall(t)]
                labelled.update(parts), long.update(other)
                apart = transitions(coded([*other, *(p for p in parts if len(p) < LEAST_RUN)]))
                sums += np.maximum(transitions(coded(some)) - apart, 0)
            long -= labelled
            yield table([], [], [*long, *labelled], len(long))
        cells = np.flatnonzero(sums)
        yield table(cells, sums[cells], [], 0)

    def table(cells, n, words: list[str], ordinary: int) -> pa.RecordBatch:
        flags = [i >= ordinary for i in range(len(words))]
        columns = [[*cells, *[None] * len(words)], [*n, *[None] * len(words)], [*[None] * len(cells), *words], [*[None] * len(cells), *flags]]
        kinds = pa.int64(), pa.int64(), pa.string(), pa.bool_()
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["cell", "n", "word", "labelled"])

    found = docs.select(F.col(text)).mapInArrow(run, "cell long, n long, word string, labelled boolean")
    return stage(found.groupBy("cell", "word").agg(F.sum("n").alias("n"), F.max("labelled").alias("labelled")), "observed")


def counted(seen: DataFrame, ratio: list[list[float]] | None) -> np.ndarray:
    """Transitions of labelled words, of ordinary text, and of long words that do not look random by a ratio."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(SYMBOLS * SYMBOLS, np.int64) for _ in range(2)]
        scores = None if ratio is None else scores_of(ratio)
        for batch in batches:
            words, labelled = batch.columns
            long = words.filter(pc.invert(labelled)).to_pylist()
            if scores is not None:
                long = [w for w in long if not any(stretches(w, scores))]
            for total, some in zip(sums, (words.filter(labelled).to_pylist(), long)):
                total += transitions(coded(some))
        cells = np.flatnonzero(sums[0] + sums[1])
        yield pa.record_batch([pa.array(cells), pa.array(sums[0][cells]), pa.array(sums[1][cells])], ["cell", "random", "rare"])

    words = seen.filter("word IS NOT NULL").select("word", "labelled").mapInArrow(count, "cell long, random long, rare long")
    counts = np.zeros((3, SYMBOLS * SYMBOLS))
    for row in words.groupBy("cell").agg(F.sum("random").alias("random"), F.sum("rare").alias("rare")).collect():
        counts[0, row["cell"]], counts[2, row["cell"]] = row["random"], row["rare"]
    for row in seen.filter("word IS NULL").select("cell", "n").collect():  # no more than there are transitions
        counts[1, row["cell"]] = row["n"]
    counts = counts.reshape(3, SYMBOLS, SYMBOLS)
    counts[:, -1, -1] = 0
    return counts


def ratio_of(counts: np.ndarray) -> list[list[float]]:
    """Log-likelihood ratio of each transition, random over ordinary; 0 without a labelled random string."""
    if counts[0].sum() == 0:
        return np.zeros((SYMBOLS, SYMBOLS)).tolist()
    # What occurs once among words that are long enough may be the one secret that is looked for.
    counts = np.array([counts[0], counts[1] + np.maximum(counts[2] - 1, 0)])
    # Names are written in capitals as well, with the same letters following each other.
    upper, lower = slice(0, 26), slice(26, 52)
    counts[1][upper, upper] += SHOUTED * counts[1][lower, lower]
    # and joined by a capital: the last letter of one word, then the first of another.
    ends, begins = counts[1][lower, -1], counts[1][-1, lower] + counts[1][-1, upper]
    counts[1][lower, upper] += SHOUTED * np.outer(ends, begins) / max(begins.sum(), 1)
    # A character that is rare by itself is rare after one that was never seen before it.
    single = counts.sum(1, keepdims=True) + 1
    single /= single.sum(2, keepdims=True)
    random, ordinary = (counts + WEIGHT * single) / (counts.sum(2, keepdims=True) + WEIGHT)
    even = np.where(np.arange(SYMBOLS) < 62, 1 / 62, 0)
    ratio = np.log((1 - EVEN) * random + EVEN * even) - np.log(ordinary)
    ratio[-1, :] = ratio[:, -1] = 0  # where a run begins and ends says nothing
    return ratio.tolist()


def train(docs: DataFrame, text: str = "text") -> list[list[float]]:
    """The log-likelihood ratio of each transition; all texts are read, once.

    Without a labelled random string the ratios are 0 and no stretch is a secret.
    """
    seen = observed(docs, text)
    return ratio_of(counted(seen, ratio_of(counted(seen, None))))


def scores_of(ratio: list[list[float]]) -> np.ndarray:
    return np.clip(np.array(ratio), -CLIP, CLIP)


def random_spans(text: str, taken: list[tuple[int, int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches that look random, beside the spans of the fixed patterns."""
    out, reached = [], list(accumulate((end for _, _, end in taken), max))
    for m in RUN.finditer(text):
        for a, b in outside(m.start(), m.end(), taken, reached):
            if b - a >= LEAST_RUN:
                out += [(3, a + x, a + y) for x, y in stretches(text[a:b], scores)]
    return out


def stretches(run: str, scores: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of a run that look random.

    A run falls into words of letters and digits, so that a name or a path beside a secret
    does not hide it. Words that look random and are one character apart are one stretch,
    as encoded strings hold such characters.
    """
    codes = CODE[np.frombuffer(run.encode(), np.uint8)]
    sums = np.concatenate(([0.0], np.cumsum(scores[codes[:-1], codes[1:]])))
    start, end, total = 0, -1, 0.0

    def is_secret() -> bool:
        return total >= LEAST_RATIO and end - start >= LEAST_RUN

    for m in WORD.finditer(run):
        a, b = m.span()
        score = float(sums[b - 1] - sums[a])
        if score <= LEAST_EACH * (b - a - 1):
            continue
        if a == end + 1:
            end, total = b, total + score
            continue
        if is_secret():
            yield start, end
        start, end, total = a, b, score
    if is_secret():
        yield start, end


def outside(start: int, end: int, taken: list[tuple[int, int, int]], reached: list[int]) -> list[tuple[int, int]]:
    """The parts of a run that no taken span covers: taken is in order of starts, reached the furthest end so far."""
    first = bisect_left(taken, start, key=itemgetter(1))
    parts, reach = [], max(start, reached[first - 1]) if first else start
    for _, a, b in taken[first : bisect_left(taken, end, lo=first, key=itemgetter(1))]:
        if a > reach:
            parts.append((reach, a))
        reach = max(reach, b)
    return parts + ([(reach, end)] if reach < end else [])


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs and base_spans, spans: arrays of (kind, start, end) in code points.

    base_spans are those of the fixed patterns, spans has the random-looking runs as well,
    both by start and then kind. NULL and empty texts have none; repeated rows are scanned
    each. Columns of docs that share a name with the result's raise.
    """
    clash = {"base_spans", "spans"} & set(docs.columns)
    if clash:
        raise ValueError(f"docs already has {sorted(clash)}")
    ratios, place, columns = train(docs, text), docs.columns.index(text), docs.columns
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scores_of(ratios)
        for batch in batches:
            base, full = [], []
            for t in texts_in(batch.column(place)):
                found = base_spans(t)
                base.append(named(found))
                full.append(named(sorted(found + random_spans(t, found, scores), key=lambda s: (s[1], s[0]))))
            extra = [pa.array(base, span), pa.array(full, span)]
            yield pa.record_batch([*batch.columns, *extra], [*columns, "base_spans", "spans"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{names}, base_spans {kind}, spans {kind}")


def named(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of find_secrets."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined("base_spans"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
