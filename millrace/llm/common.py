"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components  # noqa: F401
from ..operators.loop import removed, shared_dir, written  # noqa: F401

#: Text bytes that a Python worker handles at once; a longer text is handled alone.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with as many underscores after them as it takes to be none of the columns (whatever their case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sampled(df: DataFrame, rows: int, total: int, *keys: str) -> DataFrame:
    """At most `rows` of the `total` rows, those least by a hash of the keys.  A cut of the hash comes first, so that what is
    ordered is bounded by the sample and not by the number of tasks; where too few pass it, the sample is smaller."""
    order = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    share = min(1.0, (4 * rows + 100) / max(total, 1))
    return df.where(order < int(share * (1 << 40)) + 1).orderBy(order, *keys).limit(rows)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold at most limit bytes (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends, _ = string_buffer(batch.column(column))
        first, n = 0, batch.num_rows
        while first < n:
            last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, side="right"))
            last = min(n, max(last, first + 1))
            yield batch.slice(first, last - first)
            first = last


def string_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end (null: empty), the end of each text, its start."""
    if pa.types.is_large_string(array.type) or array.null_count:
        array = array.cast(pa.string()).fill_null("")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    return data, offsets[1:], offsets[:-1]


def binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose i-th value holds the next counts[i] items of flat."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))]) * flat.dtype.itemsize
    if ends[-1] >= 2**31:
        raise ValueError("a batch of binary values exceeds 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def unpack(array: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All items of a binary array on end, and the number of items of each value; no nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if len(array) == 0:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(data[offsets[0] : offsets[-1]], dtype) if offsets[-1] > offsets[0] else np.zeros(0, dtype)
    return flat, np.diff(offsets) // size


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def per_process(build: Callable):
    """build's result, made once in each Python worker and kept under the broadcast's id."""
    kept: dict = {}

    def get(key, *args):
        if key not in kept:
            kept.clear()
            kept[key] = build(*args)
        return kept[key]

    return get
