"""Shuffles of packed arrays: a task sends one binary row a bucket instead of a row a key.

Integers are stored as byte planes, sorted ones as differences, so that the codec of the shuffle removes what is zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import released


def buckets(docs: DataFrame, size: int = 2 << 20) -> int:
    """How many buckets bound what each holds: one for ``size`` bytes of input, a power of two."""
    spark = docs.sparkSession
    total = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # where Spark can't tell the size, the number of shuffle partitions follows the data
    n = -(-total // size) if total < spark._jvm.Long.MAX_VALUE else 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << min(23, max(4, (n - 1).bit_length()))


def planes(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(dtype).ravel()


def ascending(x: np.ndarray) -> bytes:
    """A sorted unsigned array as differences."""
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def unascending(raw: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unplanes(raw, dtype), dtype=dtype)


def planes_by(x: np.ndarray, start: np.ndarray, sizes: np.ndarray | None = None) -> pa.Array:
    """``planes`` of each part ``x[start[g] : start[g + 1]]``, cut to ``sizes[g]`` bytes an element, without a loop over parts."""
    n = np.diff(start)
    sizes = np.full(len(n), x.itemsize) if sizes is None else sizes
    stop = np.append(0, np.cumsum(sizes * n))
    raw, out = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize), np.empty(stop[-1], np.uint8)
    at, step = np.arange(len(x)) + np.repeat(stop[:-1] - start[:-1], n), np.repeat(n, n)
    every, each = sizes.min(initial=x.itemsize), np.repeat(sizes, n)
    for p in range(sizes.max(initial=0)):
        some = slice(None) if p < every else each > p
        out[at[some]] = raw[some, p]
        at += step
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(stop.astype(np.int32)), pa.py_buffer(out)])


def ascending_by(x: np.ndarray, start: np.ndarray) -> pa.Array:
    """``ascending`` of each part, none of which is empty."""
    d = np.diff(x, prepend=x.dtype.type(0))
    d[start[:-1]] = x[start[:-1]]
    return planes_by(d, start)


def bounds(keys: np.ndarray, count: int) -> np.ndarray:
    """Where each of ``count`` buckets (a power of two, by the top bits) begins and ends in the sorted ``keys``."""
    shift = 64 - (count.bit_length() - 1)
    starts = np.arange(count, dtype=np.uint64) << np.uint64(shift)
    return np.append(np.searchsorted(keys, starts), len(keys))


def exchange(rows: DataFrame, reduce: Callable[[int, list[dict]], Iterator[pa.RecordBatch]], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Bring the rows of each ``bucket`` together and hand them to ``reduce(bucket, rows)``, one bucket in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            names = b.schema.names
            for i, own in enumerate(b.column("bucket").to_pylist()):
                if own != bucket:
                    if held:
                        yield from reduce(bucket, held)
                    bucket, held = own, []
                held.append({n: b.column(k)[i].as_py() for k, n in enumerate(names)})
        if held:
            yield from reduce(bucket, held)

    return rows.repartition("bucket").sortWithinPartitions("bucket", *order).mapInArrow(released(run), schema)
