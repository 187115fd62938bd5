"""Whitening of embeddings by an eigendecomposition that partitions build up and combine.

Entries become integers on a fixed lattice, so sums and deviations are exact. A partition
turns its centred rows into rank-one updates of a spectrum; spectra are combined in a tree
of small groups, one update for each eigenpair. One more pass projects all rows on the
combined basis, sums their products and solves that small, nearly diagonal matrix
(Rayleigh-Ritz). The driver sees sums, one basis and one matrix of the vectors' dimension,
whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millrace.llm.spectra import Spectrum, combined, empty, folded
from millrace.sources.staging import stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FAN = 16  # spectra that one task combines
BLOCK = 4096  # rows that a task holds as arrays at once
LARGEST = 2.0**62  # of a scaled entry; int64 holds it
SPECTRUM = "part long, vals array<double>, vecs array<double>"


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: np.ndarray  # exact, of each dimension
    values: np.ndarray  # eigenvalues, falling
    components: np.ndarray  # as columns, in that order
    trace: float


def lattice(rows: DataFrame, id: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x): x is floor(scale * entry) + shift of every entry, as longs.

    Left out are rows whose vector is NULL, empty, holds a NULL, a NaN, an infinity or an
    entry that no long can hold, and those of another length than most vectors have
    (of two equally frequent lengths the longer one counts).
    """
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    found = rows.select(F.col(id).alias("id"), c.alias("c"))
    sound = F.forall("c", lambda v: v.isNotNull() & (F.abs(v) * scale < LARGEST))
    found = found.filter((F.size("c") > 0) & sound)
    lengths = found.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths:
        found = found.filter(F.size("c") == lengths["d"])
    return found.select("id", F.transform("c", lambda v: F.floor(v * scale) + F.lit(shift).cast("long")).alias("x"))


def blocks(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches and their integer vectors as rows of a matrix."""
    for batch in batches:
        for start in range(0, len(batch), BLOCK):
            part = batch.slice(start, BLOCK)
            yield part, part.column(place).flatten().to_numpy().reshape(len(part), -1)


def summed(tables: DataFrame, dims: int) -> np.ndarray:
    """The sum of rows (values array<double>), added up by Spark one entry at a time."""
    cells = tables.select(F.posexplode("values").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(dims)
    for row in cells.collect():  # as many as the array has entries
        out[row["at"]] = row["value"]
    return out


def products(rows: DataFrame, project, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, sums): the sums of y y^T and of y over y = project(x) of all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, sums = np.zeros((width, width)), np.zeros(width)
        for _, x in blocks(batches, 0):
            y = project(x)
            matrix += y.T @ y
            sums += y.sum(0)
        yield pa.record_batch([pa.array([np.append(matrix.ravel(), sums)])], ["values"])

    found = summed(rows.select("x").mapInArrow(run, "values array<double>"), width * width + width)
    return found[: width * width].reshape(width, width), found[width * width :]


def partition_spectra(rows: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, seen = empty(len(sums)), False
        for _, x in blocks(batches, 0):
            spectrum, seen = folded(spectrum, centred(x, n, sums)), True
        if seen:
            yield as_row(TaskContext.get().partitionId(), spectrum)

    return rows.select("x").mapInArrow(run, SPECTRUM)


def as_row(part: int, spectrum: Spectrum) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int64()), pa.array([spectrum[0]]), pa.array([spectrum[1].ravel()])]
    return pa.record_batch(columns, ["part", "vals", "vecs"])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once."""
    return (n * x - sums) / n


def one_spectrum(spectra: DataFrame) -> Spectrum:
    """All partitions' spectra combined, in rounds of FAN each."""
    def run(table: pa.Table) -> pa.Table:
        found = None
        for values, vectors in zip(table["vals"].to_pylist(), table["vecs"].to_pylist()):
            spectrum = np.array(values), np.array(vectors).reshape(len(values), -1)
            found = spectrum if found is None else combined(found, spectrum)
        return pa.Table.from_batches([as_row(table["part"][0].as_py() // FAN, found)])

    spectra = stage(spectra, "spectra")
    while spectra.agg(F.max("part")).first()[0] > 0:
        groups = spectra.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInArrow(run, SPECTRUM)
        spectra = stage(groups, "spectra")
    row = spectra.first()
    return np.array(row["vals"]), np.array(row["vecs"]).reshape(len(row["vals"]), -1)


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of rows (x array<long>) of one length; None if there are none."""
    cells = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at")
    cells = cells.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    if not cells:
        return None
    n, sums = cells[0]["n"], np.zeros(len(cells), np.int64)
    for row in cells:
        sums[row["at"]] = int(row["s"])
    _, basis = one_spectrum(partition_spectra(rows, n, sums))
    scatter, shift = products(rows, lambda x: centred(x, n, sums) @ basis, len(sums))
    values, turn = np.linalg.eigh((scatter - np.outer(shift, shift) / n) / n)
    components = (basis @ turn)[:, ::-1]
    largest = components[np.abs(components).argmax(0), np.arange(len(sums))]
    return Whitening(n, sums, values[::-1].clip(0), components * np.sign(largest), float(values.sum()))


def whitened(rows: DataFrame, fitted: Whitening, most: int = COMPONENTS) -> DataFrame:
    """(id, deviation, whitened): the exact sum of (n*x - sums)^2 and up to `most` whitened coordinates.

    A component without variance has NULL coordinates. A deviation beyond a long is an error.
    """
    kind = rows.schema["id"].dataType.simpleString()
    n, sums = fitted.n, fitted.sums
    scale, flat = whitener(fitted, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, 1):
            off = n * x - sums
            if (np.square(off.astype(float)).sum(1) >= LARGEST).any():
                raise OverflowError("the deviation of a vector is beyond a long")
            y = (off / n) @ scale
            y = pa.array(y.ravel(), mask=np.tile(flat, len(y)))
            width = np.arange(len(part) + 1, dtype=np.int32) * len(flat)
            columns = [part.column(0), pa.array((off * off).sum(1)), pa.ListArray.from_arrays(width, y)]
            yield pa.record_batch(columns, ["id", "deviation", "whitened"])

    return rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def whitener(fitted: Whitening, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix from centred vectors to whitened ones, which components have no variance)."""
    values = fitted.values[:most]
    flat = values <= np.finfo(float).eps * len(fitted.sums) * max(fitted.values[0], 0)
    return fitted.components[:, :most] / np.sqrt(np.where(flat, 1, values)), flat


def identity_error(rows: DataFrame, fitted: Whitening, most: int = COMPONENTS) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    scale, flat = whitener(fitted, most)
    n, sums, scale = fitted.n, fitted.sums, scale[:, ~flat]
    matrix, shift = products(rows, lambda x: centred(x, n, sums) @ scale, scale.shape[1])
    return float(np.abs(matrix / n - np.outer(shift, shift) / n**2 - np.eye(len(matrix))).max(initial=0))


def whiten(rows: DataFrame, id: str, vector: str, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every sound row and component.

    Sound rows are those that lattice() keeps; a NULL or repeated id stays as it is, other
    columns are not read, and a table without sound rows gives none. Equal rows get equal
    results. There are up to `most` components, no more than dimensions, by falling
    eigenvalue. Where there is no variance at all, explained is NULL too.
    """
    found = stage(lattice(rows, id, vector), "lattice")
    fitted = fit(found)
    kind = rows.schema[id].dataType.simpleString()
    if fitted is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, "
                                                     "whitened double, explained double, identity_error double")
    share = [float(v / fitted.trace) if fitted.trace > 0 else None for v in fitted.values[:most]]
    shares = F.array(*(F.lit(s).cast("double") for s in share))
    error = identity_error(found, fitted, most)
    wide = whitened(found, fitted, most).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return wide.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"),
        "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
