"""Tables of 64-bit keys in sorted, memory-mapped files, for look-ups without a join.

Rows are dealt over files by key. The files' sizes travel with the table, so that a file
that is missing or cut short is an error and not a key that is unknown.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millrace.llm.shared import mapped, save, shared_folder
from millrace.sources.staging import stage

ROWS = 2_000_000  # of a file


@dataclass
class MappedTable:
    folder: str
    sizes: dict[int, int]  # rows of each file that has any
    shards: int
    opened: dict = field(default_factory=dict, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "opened": {}}

    def file(self, shard: int) -> np.ndarray:
        """Keys, then the other columns, as rows of one array."""
        if shard not in self.opened:
            found = mapped(f"{self.folder}/{shard}.npy")
            if found.shape[1] != self.sizes[shard]:
                raise OSError(f"{self.folder}/{shard}.npy holds {found.shape[1]} rows of {self.sizes[shard]}")
            self.opened[shard] = found
        return self.opened[shard]

    def find(self, keys: np.ndarray, check: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray]:
        """(which rows have a key, their other columns or 0); check: values that the next columns must have as well."""
        hit = np.zeros(len(keys), bool)
        out: np.ndarray | None = None
        owner = keys % self.shards
        for shard in np.unique(owner).tolist():
            if shard not in self.sizes:
                continue
            rows, mine = self.file(shard), np.flatnonzero(owner == shard)
            if out is None:
                out = np.zeros((len(rows) - 1, len(keys)), np.int64)
            order = mine[np.argsort(keys[mine])]
            at = np.searchsorted(rows[0], keys[order])
            while len(order):
                inside = at < rows.shape[1]
                order, at = order[inside], at[inside]
                same = rows[0][at] == keys[order]
                order, at = order[same], at[same]
                found = np.ones(len(order), bool)
                for column, values in enumerate(check, 1):
                    found &= rows[column][at] == values[order]
                hit[order[found]] = True
                out[:, order[found]] = rows[1:, at[found]]
                order, at = order[~found], at[~found] + 1  # the next row of that key
        return hit, np.zeros((0, len(keys)), np.int64) if out is None else out


def mapped_table(rows: DataFrame, label: str) -> MappedTable:
    """Rows of longs, the first being the key."""
    names, rows = rows.columns, stage(rows, label)
    shards, folder = max(1, -(-rows.count() // ROWS)), shared_folder(rows.sparkSession, label)

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame[names].to_numpy(np.int64).T
        values = np.ascontiguousarray(values[:, np.argsort(values[0], kind="stable")])
        shard = int(values[0, 0] % shards)
        save(f"{folder}/{shard}.npy", values)
        return pd.DataFrame({"shard": [shard], "n": [values.shape[1]]})

    written = rows.groupBy(F.pmod(names[0], F.lit(shards))).applyInPandas(write, "shard int, n long").collect()
    return MappedTable(folder, {r["shard"]: r["n"] for r in written}, shards)
