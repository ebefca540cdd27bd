"""Sums of numpy work over all rows: each task adds up its own, and the driver gets one vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Partitions whose sums go to the driver as they are; of more, groups are added up by tasks first.
DIRECT = 64
#: Rows of one side of a pair of blocks: 16 MB of 64 numbers.
BLOCK = 32_768


def blocks(n: int, block: int = BLOCK) -> int:
    """Into how many blocks `n` rows go that meet in pairs of blocks.

    A row is sent once to every block, so few large blocks keep the shuffle
    small; up to four blocks of any size give the tasks something to share.
    """
    return max(1, -(-n // block), min(4, -(-n // 2_048)))


def summed(rows: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of `add` over all Arrow batches of `rows`, a vector of `size` numbers.

    Every task hands on one vector.  Where there are many tasks their vectors
    are added up by `DIRECT` tasks before they reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, any_rows = np.zeros(size), False
        for b in batches:
            if b.num_rows:
                found, any_rows = found + add(b), True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % DIRECT], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["g", "v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(v.as_py()) for b in batches for v in b.column(1)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.sum(found, axis=0).tobytes()], pa.binary())], names=["g", "v"])

    parts = rows.mapInArrow(run, "g int, v binary")
    if rows.rdd.getNumPartitions() > DIRECT:
        parts = parts.repartition(DIRECT, "g").mapInArrow(again, "g int, v binary")
    return np.sum([np.frombuffer(r["v"]) for r in parts.select("v").collect()] or [np.zeros(size)], axis=0)


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))
