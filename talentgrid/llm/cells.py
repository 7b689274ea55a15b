"""Sorted numbers packed into small binary cells, for shuffles of very many hashes.

A map task gathers a block of texts, cuts what it has into one cell per bucket of hashes, and ships a cell
as one compressed value. Against a row per hash this halves the bytes and spares the row overhead. A bucket
is a range of hashes, and one task; `buckets` comes from spark.sql.shuffle.partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = "bucket int, cell binary"
CELL_SCHEMA = pa.schema([("bucket", pa.int32()), ("cell", pa.binary())])


def bucket_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(*arrays: np.ndarray) -> bytes:
    """One compressed value; integers are laid out by byte, as their high bytes compress away."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(head.tobytes() + b"".join(planes), 1)


def unpack(cell: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(cell)
    (n,) = np.frombuffer(raw, np.int64, 1)
    head = np.frombuffer(raw, np.int64, 2 * int(n), 8).reshape(int(n), 2)
    out, at = [], 8 + 16 * int(n)
    for char, length in head.tolist():
        kind = np.dtype(chr(char))
        size = length * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def small(values: np.ndarray) -> np.ndarray:
    """In the narrowest unsigned type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted 64-bit values as differences."""
    return np.diff(keys, prepend=np.uint64(0))


def ungaps(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values.astype(np.uint64))


def edges(buckets: int) -> np.ndarray:
    """The first hash of each bucket but the first."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(edges(buckets), keys, "right")


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; the caller's list is emptied, as a block's arrays are large."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return starts, np.diff(starts, append=len(sorted_keys))


def ranges(sorted_keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket that has keys."""
    at = np.concatenate([[0], np.searchsorted(sorted_keys, edges(buckets), "left"), [len(sorted_keys)]])
    for b in np.flatnonzero(np.diff(at)).tolist():
        yield b, int(at[b]), int(at[b + 1])


def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=CELL_SCHEMA)


def by_bucket(cells: DataFrame, buckets: int, work: Callable[[int, Iterator[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring each bucket's cells together in a task of its own and run `work(bucket, cells)` there, which reads them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, c) for x in batches for b, c in zip(x.column(0).to_pylist(), x.column(1), strict=True))
        for b, group in groupby(rows, key=lambda r: r[0]):
            yield from work(b, (c.as_py() for _, c in group))
        pa.default_memory_pool().release_unused()  # see words.slices

    return cells.repartitionById(buckets, F.col("bucket")).mapInArrow(run, schema)
