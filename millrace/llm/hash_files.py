"""Sets of 64-bit hashes in mapped files: a filter of rows that shuffles only the set.

The set is dealt over shards, each a sorted array in the shared folder. Tasks map the
arrays and look their own rows' hashes up, so wide rows stay where they are, and a set of
any size costs a task no memory of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from millrace.llm.shared import mapped, save, shared_folder, tidy
from millrace.sources.staging import stage

SHARD = 2_000_000  # hashes of a file


@dataclass(frozen=True)
class HashSet:
    folder: str
    shards: int
    written: frozenset[int]  # shards that hold any

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which of some int64 hashes are in the set."""
        out, owner = np.zeros(len(hashes), bool), hashes % self.shards
        for shard in np.unique(owner).tolist():
            if shard in self.written:  # a file that is missing is an error
                known, mine = mapped(f"{self.folder}/{shard}.npy"), np.flatnonzero(owner == shard)
                needles = hashes[mine]
                order = np.argsort(needles)
                at = np.minimum(np.searchsorted(known, needles[order]), len(known) - 1)
                out[mine[order]] = known[at] == needles[order]
        return out


def hash_set(hashes: DataFrame, label: str) -> HashSet:
    """The distinct values of the one, long column of hashes; NULLs are left out."""
    (name,) = hashes.columns
    rows = stage(hashes.filter(F.col(name).isNotNull()).distinct(), label)
    shards, folder = max(1, -(-rows.count() // SHARD)), shared_folder(hashes.sparkSession, label)

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(frame[name].to_numpy())
        shard = int(values[0] % shards)
        save(f"{folder}/{shard}.npy", values)
        return pd.DataFrame({"shard": [shard]})

    written = rows.groupBy(F.pmod(name, F.lit(shards))).applyInPandas(write, "shard int").collect()
    return HashSet(folder, shards, frozenset(row["shard"] for row in written))


def among(batches: Iterator[pa.RecordBatch], found: HashSet | None) -> Iterator[pa.RecordBatch]:
    """Inside a task: the rows whose key, a long in the last column, is in a set, without that column; all rows without a set."""
    for batch in batches:
        if found is not None:
            hit = found.has(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64))
            batch = pa.record_batch(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(hit))
        yield batch


def rows_in(rows: DataFrame, key: Column, found: HashSet) -> DataFrame:
    """The rows whose key (a long, not NULL) is in the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from among(batches, found)

    return rows.select("*", key.alias("_key")).mapInArrow(tidy(run), StructType(list(rows.schema.fields)))
