"""One pass over the rows that ends in one summed vector.

Gradients and sufficient statistics are such sums. Every task sums its rows into
one vector, cuts it into small blocks, and the blocks are added up by a shuffle:
many tasks share the adding, none gets more than (tasks x block) numbers, and
the driver only receives the total, which is as long as the model is big.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from nestfold.session import ship_package

BLOCK = 4096  # numbers per block: 32 KB
DIRECT = 2_000_000  # numbers (16 MB) that may come to the driver unsummed


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a 2-d array, without a Python loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def batches_of(
    stream: Iterator[pa.RecordBatch], features: str, target: str | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    for batch in stream:
        if batch.num_rows:
            y = None if target is None else np.asarray(batch.column(target).to_numpy(zero_copy_only=False), dtype=np.float64)
            yield matrix(batch.column(features)), y


def sum_over_rows(
    df: DataFrame, columns: Sequence[str], task: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int,
    shared: Broadcast | None = None,
) -> np.ndarray:
    """Sum of ``task``'s vectors over all partitions of ``df``.

    ``shared`` is a broadcast that only this pass uses; it is released at the end.

    ``df`` should be a scan of a written or cached table. If it has few
    partitions and the vector is short, the partial sums go to the driver
    directly; the check keeps that below a fixed number of bytes.
    """
    ship_package(df.sparkSession)
    tasks = df.rdd.getNumPartitions()

    def partial(stream):
        total = task(stream)
        if total is None:
            return
        total = np.ascontiguousarray(total, dtype=np.float64)
        starts = range(0, size, BLOCK)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([s // BLOCK for s in starts], pa.int32()),
            "data": pa.array([total[s:s + BLOCK].tobytes() for s in starts], pa.binary()),
        })

    def add(stream):
        block, total = None, None
        for batch in stream:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                part = np.frombuffer(data.as_buffer(), dtype=np.float64)
                block, total = b, part.copy() if total is None else total + part
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    def add_group(key, stream):
        yield from add(stream)

    parts = df.select(*columns).mapInArrow(partial, "block int, data binary")
    totals = parts if tasks * size <= DIRECT else parts.groupBy("block").applyInArrow(_typed(add_group), "block int, data binary")
    out = np.zeros(size)
    for row in totals.collect():
        data = np.frombuffer(row["data"], dtype=np.float64)
        out[row["block"] * BLOCK: row["block"] * BLOCK + len(data)] += data
    if shared is not None:
        shared.destroy()
    return out


def _typed(fn):
    """The streaming form of applyInArrow is chosen by its type hints."""
    def group(key: tuple[pa.Scalar, ...], stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(key, stream)

    return group


def append_columns(
    df: DataFrame, features: str, keep: Sequence[str], compute: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str
) -> DataFrame:
    """Score rows in Arrow batches: kept columns plus what ``compute`` returns."""
    ship_package(df.sparkSession)

    def task(stream):
        for batch in stream:
            if not batch.num_rows:
                continue
            out = compute(matrix(batch.column(features)))
            arrays = {k: batch.column(k) for k in keep}
            for name, values in out.items():
                arrays[name] = pa.array(list(values)) if values.ndim == 2 else pa.array(values)
            yield pa.RecordBatch.from_pydict(arrays)

    kept = df.select(*keep).schema
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    wanted = list(dict.fromkeys([*keep, features]))
    return df.select(*wanted).mapInArrow(task, f"{types}, {schema}" if types else schema)
