"""Files that tasks write and map in the folder all executors share."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from millrace.sources.staging import scratch_path


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir as a path that tasks can map."""
    path = scratch_path(spark, label)
    if path.startswith("file:"):
        path = path.removeprefix("file:").replace("///", "/", 1).replace("//", "/", 1)
    if "://" in path:
        raise ValueError("memory-mapped models need spark.checkpoint.dir on a mounted file system")
    os.makedirs(path, exist_ok=True)
    return path


def save(path: str, array: np.ndarray) -> None:
    """Write whole or not at all: a repeated task replaces the file by the same bytes."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, array)
        out.flush()
        os.fsync(out.fileno())
    os.replace(part, path)


def mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task over batches, followed by release()."""
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return task
