"""Packed exchange of 64-bit hashes: ranges of the hash space gather, as binary blocks, what all texts have there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries

#: Bytes of a hash in a block; the range gives the bits above them.
WIDTH = 6


def range_bits(docs: DataFrame, text: str, items_per_byte: float, items: int = 4_000_000) -> int:
    """Bits of the range number, so that a range gets about `items` hashes: from the measured size of all texts."""
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return int(np.clip(np.ceil(np.log2(max(1.0, size * items_per_byte / items))), 4, 64 - 8 * WIDTH))


def pack_hashes(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :WIDTH]).reshape(-1)


def unpack_hashes(flat: np.ndarray, key: int, bits: int) -> np.ndarray:
    """Hash as range and lower bytes; equal for equal hashes of a range."""
    out = np.zeros((len(flat) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = flat.reshape(-1, WIDTH)
    return out.view("<u8").reshape(-1) | np.uint64(key << (8 * WIDTH))


def ranges(h: np.ndarray, doc: np.ndarray, n_docs: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the hashes by range (documents stay in order), their number by range and document, present ranges."""
    r = (h >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(r.astype(np.uint16), kind="stable")
    counts = np.bincount(r * n_docs + doc, minlength=(n_docs << bits)).reshape(-1, n_docs)
    return order, counts, np.flatnonzero(counts.any(1))


def block_columns(h: np.ndarray, doc: np.ndarray, names: np.ndarray, bits: int, *more: np.ndarray) -> tuple[pa.Array, ...]:
    """key, names, counts, hashes and the packed `more` of every range that a chunk of documents has hashes in.

    names: bytes that name a document, one row each; only documents with hashes in a range are named there.
    """
    order, counts, keys = ranges(h, doc, len(names), bits)
    own = counts[keys]
    per_key = own.sum(1)
    row, at = np.nonzero(own)
    held = np.bincount(row, minlength=len(keys))
    flat = pack_hashes(h[order])
    out = [pa.array(keys.astype(np.int32)), binaries(names[at].reshape(-1), held * names.shape[1]), binaries(own[row, at].astype(np.uint32), held), binaries(flat, per_key * WIDTH)]
    return (*out, *(binaries(m[order], per_key) for m in more))
