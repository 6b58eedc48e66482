"""Removal of 50-byte strings that a document with a smaller id has: suffix arrays over shared passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, mix, string_buffer, table, text_chunks, unpack, written
from .exchange import block_columns, pack_hashes, range_bits, unpack_hashes

#: Bytes of a string that is removed where it repeats; bytes of an anchor in it.
LENGTH, GRAM = 50, 18
#: Windows that are worked on at once; a longer text is cut into pieces of as many, which share LENGTH - 1 bytes.
PIECE = 1 << 20
#: Bytes of a suffix array, and of all those of a task.
ARRAY_BYTES, TASK_BYTES = 1 << 20, 3 << 20
#: Runs that a range gathers, about.
RANGE_ITEMS = 900_000
#: Contexts of an anchor that are compared in one block; more are compared by pairs of blocks.
BLOCK = 20_000
#: Repeated runs that a task remembers from chunk to chunk, so that a common passage is sent about once a task.
CARRY = 1 << 18
#: Bits of the map that tells which documents may have something to look up (2 MB, whatever the input; a wrong bit only costs a shuffle of that text).
MAP_BITS = 1 << 24
_VALUE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xB7E151628AED2A6B
_NAME = np.dtype([("id", "<i8"), ("print", "<u4")])
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + (1 << 16))
        _POWERS[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS[0], _POWERS[1]


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, windows) of all runs of windows of LENGTH bytes with one anchor.

    The anchor of a window is its GRAM-byte string of the least hash, so equal windows have equal anchors
    at equal places.  The context is what the run's windows cover.  Windows don't cross the text ends.
    """
    n = len(data)
    empty = np.zeros(0, np.uint64)
    if n < LENGTH:
        return empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[:n], out=total[1:])
    gram = mix((total[GRAM:] - total[: n + 1 - GRAM]) * inverse[: n + 1 - GRAM])
    low = np.uint64((1 << 24) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    span, count = 1, LENGTH - GRAM + 1
    while 2 * span <= count:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < count:
        least = np.minimum(least[: len(least) - (count - span)], least[count - span :])
    at = (least & low).astype(np.int64)  # of the window that begins at each place
    stop = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[: len(at)]
    valid = np.arange(len(at)) + LENGTH <= stop
    first = np.flatnonzero(valid & np.append(True, (at[1:] != at[:-1]) | ~valid[:-1]))
    change = np.flatnonzero(np.append((at[1:] != at[:-1]) | ~valid[1:], True) & valid)
    size = change - first + 1
    last = first + size + LENGTH - 1
    # An anchor's hash is small, being the least of many; mixed again, anchors spread evenly over the ranges.
    return mix(gram[at[first]] ^ np.uint64(_BASE)), mix((total[last] - total[first]) * inverse[first] + size.astype(np.uint64)), first, size


_SENT = "key int, doc_id long, print long, names binary, counts binary, hashes binary, contexts binary, firsts binary, sizes binary"
_FOUND = "doc_id long, print long, firsts binary, sizes binary, hashes binary, alike binary"


class _Seen:
    """Contexts that repeat in a task, and the least document that has each; forgets all when it is full."""

    def __init__(self) -> None:
        self.h, self.c, self.least = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def lower(self, h: np.ndarray, c: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The least document of each context in the chunk or before it."""
        if not len(self.h) or not len(h):
            return least
        lo, hi = np.searchsorted(self.h, h), np.searchsorted(self.h, h, side="right")
        out = least.copy()
        while len(live := np.flatnonzero(lo < hi)):
            at = lo[live]
            same = self.c[at] == c[live]
            out[live[same]] = np.minimum(out[live[same]], self.least[at[same]])
            lo[live] += 1
        return out

    def add(self, h: np.ndarray, c: np.ndarray, least: np.ndarray) -> None:
        h, c, least = np.concatenate([self.h, h]), np.concatenate([self.c, c]), np.concatenate([self.least, least])
        order = np.lexsort((least, c, h))
        h, c, least = h[order], c[order], least[order]
        new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])) if len(h) else np.zeros(0, bool)
        if new.sum() > CARRY:
            self.__init__()
        else:
            self.h, self.c, self.least = h[new], c[new], least[new]


def _send(bits: int, salts: int):
    """Of every chunk: blocks of its anchors by range; and, as rows of a document, runs of windows whose whole
    context stands in the chunk, or before it in the task, in a document with a smaller id too, which need no further look."""
    names = [c.split()[0] for c in _SENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in text_chunks(batches, "text", PIECE):
            data, ends, starts = string_buffer(batch.column("text"))
            ids, prints = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "print"))
            for lo in range(0, max(1, len(data)), PIECE):  # one turn, unless a single text is longer than a piece
                part = data[lo : lo + PIECE + LENGTH - 1]
                h, c, first, size = anchors(part, np.array([len(part)]) if len(ends) == 1 else ends)
                doc = np.searchsorted(ends, first + lo, side="right")
                first = first + lo - starts[doc]
                order = np.lexsort((ids[doc], c, h))
                h, c, doc, first, size = h[order], c[order], doc[order], first[order], size[order]
                begins = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))) if len(h) else np.zeros(0, np.int64)
                width = np.diff(np.append(begins, len(h)))
                here = ids[doc[begins]]
                known = seen.lower(h[begins], c[begins], here)
                again = (known < here) | (ids[doc[begins + width - 1]] > here) if len(begins) else np.zeros(0, bool)
                seen.add(h[begins][again], c[begins][again], known[again])
                least = np.repeat(known, width)
                done = np.flatnonzero(ids[doc] > least)
                if len(done):
                    done = done[np.argsort(doc[done], kind="stable")]
                    own, count = np.unique(doc[done], return_counts=True)
                    none = pa.nulls(len(own), pa.binary())
                    # Copies have one print, so the id deals them, too.
                    key = -1 - (mix(prints[own].view(np.uint64) ^ mix(ids[own].view(np.uint64))) % np.uint64(salts)).astype(np.int32)
                    yield pa.record_batch([pa.array(key), pa.array(ids[own]), pa.array(prints[own]), none, none, none, none, binaries(first[done].astype(np.uint32), count), binaries(size[done].astype(np.uint8), count)], names=names)
                left = ids[doc] <= least
                if not left.any():
                    continue
                h, c, doc, first, size = h[left], c[left], doc[left], first[left], size[left]
                order = np.lexsort((first, doc))
                h, c, doc, first, size = h[order], c[order], doc[order], first[order], size[order]
                name = np.zeros(len(ids), _NAME)
                name["id"], name["print"] = ids, prints
                name = name.view(np.uint8).reshape(-1, _NAME.itemsize)
                context = np.ascontiguousarray(pack_hashes(c).reshape(-1, 6)).view("V6").reshape(-1)
                block = block_columns(h, doc, name, bits, context, first.astype(np.uint32), size.astype(np.uint8))
                m = len(block[0])
                yield pa.record_batch([block[0], pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *block[1:]], names=names)

    return run


def _meet(bits: int):
    """Of a range: runs whose context a document with a smaller id has (alike null), and those left of anchors that
    stand in several contexts and documents, with the anchor's hash and its number of contexts."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def packed(ids, prints, doc, *flat):
        order = np.argsort(doc, kind="stable")
        own, count = np.unique(doc[order], return_counts=True)
        return [pa.array(ids[own]), pa.array(prints[own]), *(binaries(f[order], count) for f in flat)], len(own)

    def run(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            none = pa.nulls(len(found), pa.binary())
            return pa.table([*found.select(["doc_id", "print", "firsts", "sizes"]).columns, none, none], names=names)
        who = unpack(found.column("names"), _NAME)[0]
        ids, prints = who["id"].astype(np.int64), who["print"].astype(np.int64)
        doc = np.repeat(np.arange(len(who), dtype=np.int32), unpack(found.column("counts"), np.uint32)[0])
        h = unpack_hashes(unpack(found.column("hashes"), np.uint8)[0], key[0].as_py(), bits)
        c = unpack_hashes(unpack(found.column("contexts"), np.uint8)[0], 0, bits)
        first, size = unpack(found.column("firsts"), np.uint32)[0], unpack(found.column("sizes"), np.uint8)[0]
        del found
        order = np.lexsort((ids[doc], c, h))
        h, c, doc, first, size = h[order], c[order], doc[order], first[order], size[order]
        del order
        at = np.arange(len(h))
        new_h = np.append(True, h[1:] != h[:-1])
        new_c = new_h | np.append(True, c[1:] != c[:-1])
        own = ids[doc]
        done = own > own[np.maximum.accumulate(np.where(new_c, at, 0))]
        begins = np.flatnonzero(new_h)
        width = np.diff(np.append(begins, len(h)))
        contexts = np.repeat(np.add.reduceat(new_c, begins, dtype=np.int64), width)
        several = np.repeat(np.minimum.reduceat(own, begins) != np.maximum.reduceat(own, begins), width)
        todo = ~done & several & (contexts >= 2)
        a, n = packed(ids, prints, doc[done], first[done], size[done])
        b, m = packed(ids, prints, doc[todo], first[todo], size[todo], h[todo], contexts[todo].astype(np.uint32))
        none = pa.nulls(n, pa.binary())
        return pa.concat_tables([pa.table([*a, none, none], names=names), pa.table(b, names=names)])

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the runs to look up -> one row a run, with the bytes that its windows cover."""
    for batch in batches:
        for doc_id, name, text, *lists in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "print", "text", "firsts", "sizes", "hashes", "alike"))):
            first, size, h, alike = (np.frombuffer(b"".join(x), t) for x, t in zip(lists, (np.uint32, np.uint8, np.uint64, np.uint32)))
            raw, n = text.encode(), len(first)
            for lo in range(0, n, 50_000):
                hi = min(n, lo + 50_000)
                body = [raw[f : f + s + LENGTH - 1] for f, s in zip(first[lo:hi].tolist(), size[lo:hi].tolist())]
                yield pa.record_batch([pa.array(np.full(hi - lo, doc_id)), pa.array(np.full(hi - lo, name)), pa.array(first[lo:hi].astype(np.int64)), pa.array(h[lo:hi].view(np.int64)), pa.array(alike[lo:hi].astype(np.int64)), pa.array(body, pa.binary())], names=["doc_id", "print", "first", "anchor", "alike", "body"])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of s (values 0 to 256) in order, by Larsson-Sadakane refinement: sorted by 7 values, then only
    groups of equal suffixes are sorted on, by the ranks of the suffixes h further on, and h doubles."""
    n = len(s)
    wide = np.concatenate([s, np.zeros(7, s.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key * 257 + wide[j : j + n]
    sa = np.argsort(key, kind="stable")
    slot = np.arange(n)
    head = np.maximum.accumulate(np.where(np.append(True, key[sa[1:]] != key[sa[:-1]]), slot, 0))
    rank = np.full(n + 1, -1)
    rank[sa] = head
    h = 7
    while h < n:
        same = np.append(False, head[1:] == head[:-1])
        idx = np.flatnonzero(same | np.append(same[1:], False))
        if not len(idx):
            break
        u = sa[idx]
        own, further = head[idx], rank[np.minimum(u + h, n)]
        order = np.lexsort((further, own))
        u, further = u[order], further[order]
        sa[idx] = u
        begins = np.append(True, (own[1:] != own[:-1]) | (further[1:] != further[:-1]))
        head[idx] = np.maximum.accumulate(np.where(begins, idx, 0))
        rank[u] = head[idx]
        h *= 2
    return sa


def common_prefixes(s: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 2048) -> np.ndarray:
    """Kasai's common prefix of each suffix and the one before it in sa, up to cap: in text order a prefix is at most
    one shorter than the last.  The text is cut into lanes that go on in step."""
    n = len(s)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    out = np.zeros(n, np.int64)
    step = max(1, -(-n // lanes))
    start = np.arange(0, n, step)
    held = np.zeros(len(start), np.int64)
    wide = np.append(s, -1)
    for t in range(step):
        i = start + t
        live = i < n
        i, r = i[live], place[i[live]]
        j = sa[r - 1]
        h = np.maximum(held[live] - 1, 0)
        h[r == 0] = 0
        go = np.flatnonzero(r > 0)
        while len(go):
            a, b = i[go] + h[go], j[go] + h[go]
            go = go[(h[go] < cap) & (a < n) & (b < n) & (wide[np.minimum(a, n)] == wide[np.minimum(b, n)])]
            h[go] += 1
        out[r] = h
        held[live] = h
    return out


def least_owner(bodies: list[bytes], owner: np.ndarray, array_bytes: int = ARRAY_BYTES) -> np.ndarray:
    """For each window of LENGTH bytes of each body, in order: the least owner of a body that has the same string.

    Bodies are dealt to shards; each has a suffix array, whose common prefixes of LENGTH part it into classes of
    equal strings.  Shards are merged by binary search of the sorted classes of one in those of the other.
    """
    size = np.array([len(b) - LENGTH + 1 for b in bodies])
    out = np.zeros(int(size.sum()), np.int64)
    base = np.concatenate([[0], np.cumsum(size)])
    shards, lo = [], 0
    while lo < len(bodies):
        hi, total = lo, 0
        while hi < len(bodies) and (hi == lo or total + len(bodies[hi]) < array_bytes):
            total += len(bodies[hi]) + 1
            hi += 1
        flat = np.frombuffer(b"\0".join(bodies[lo:hi]), np.uint8).astype(np.int16) + 1
        begins = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bodies[lo:hi]])])[:-1]
        flat[begins[1:] - 1] = 0
        window = np.full(len(flat), -1, np.int64)  # number of the window that begins here
        own = size[lo:hi]
        window[np.repeat(begins - np.concatenate([[0], np.cumsum(own)])[:-1], own) + np.arange(own.sum())] = base[lo] + np.arange(own.sum())
        sa = suffix_array(flat)
        prefix = common_prefixes(flat, sa, LENGTH)
        kind = np.cumsum(prefix < LENGTH)
        use = window[sa] >= 0
        place, kind = sa[use], kind[use]
        first = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        who = np.repeat(owner, size)[window[place]]
        shards.append([flat, place, np.diff(np.append(first, len(kind))), first, np.minimum.reduceat(who, first), window[place]])
        lo = hi
    if len(shards) > 1:
        keys = [np.ascontiguousarray((f[p[first][:, None] + np.arange(LENGTH)] - 1).astype(np.uint8)).view(f"S{LENGTH}").reshape(-1) for f, p, _, first, _, _ in shards]
        for a in range(len(shards)):
            for b in range(a + 1, len(shards)):
                at = np.minimum(np.searchsorted(keys[b], keys[a]), len(keys[b]) - 1)
                hit = np.flatnonzero(keys[b][at] == keys[a])
                low = np.minimum(shards[a][4][hit], shards[b][4][at[hit]])
                shards[a][4][hit] = low
                shards[b][4][at[hit]] = low
    for _, _, count, _, least, window in shards:
        out[window] = np.repeat(least, count)
    return out


def shared_windows(data: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes of each body, in order: false only where no other owner has the same string.

    Bodies (size: their windows) stand on end in data.  Equal strings have equal hashes, so a wrong yes only costs a
    look at the strings.
    """
    stop = np.cumsum(size + LENGTH - 1)
    hashes, lo = [np.zeros(0, np.uint64)], 0
    while lo < len(size):
        base = stop[lo] - size[lo] - LENGTH + 1
        hi = max(lo + 1, int(np.searchsorted(stop, base + PIECE, side="right")))
        part = data[base : stop[hi - 1]]
        power, inverse = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * power[: len(part)], out=total[1:])
        own = size[lo:hi]
        at = np.repeat(stop[lo:hi] - own - LENGTH + 1 - base - (np.cumsum(own) - own), own) + np.arange(own.sum())
        hashes.append(mix((total[at + LENGTH] - total[at]) * inverse[at]))
        lo = hi
    h = np.concatenate(hashes)
    order = np.argsort(h)
    h, who = h[order], np.repeat(owner, size)[order]
    begins = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    out = np.zeros(len(h), bool)
    if len(begins):
        several = np.minimum.reduceat(who, begins) != np.maximum.reduceat(who, begins)
        out[order] = np.repeat(several, np.diff(np.append(begins, len(h))))
    return out


def _runs(mask: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the runs of true values within a body."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = body[1:] != body[:-1]
    return np.flatnonzero(mask & np.append(True, ~mask[:-1] | change)), np.flatnonzero(mask & np.append(~mask[1:] | change, True))


def _compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Runs of windows of a task that a document with a smaller id has too: suffix arrays of the passages whose windows
    may stand in several documents."""
    order = np.lexsort((rows.column("first").to_numpy(), rows.column("doc_id").to_numpy()))
    rows = rows.take(pa.array(order))
    data, length = unpack(rows.column("body"), np.uint8)
    owner, name, first = (rows.column(k).to_numpy() for k in ("doc_id", "print", "first"))
    size = length - LENGTH + 1
    body = np.repeat(np.arange(len(size)), size)
    b, e = _runs(shared_windows(data, size, owner), body)
    # Of each passage: its body, its first window there and its windows.
    of, at, many = body[b], b - (np.cumsum(size) - size)[body[b]], e - b + 1
    start = (np.cumsum(length) - length)[of] + at
    raw = data.tobytes()
    bodies = [raw[s : s + n + LENGTH - 1] for s, n in zip(start.tolist(), many.tolist())]
    passage = np.repeat(np.arange(len(of)), many)
    b, e = _runs(least_owner(bodies, owner[of]) < owner[of][passage], passage)
    own = of[passage[b]]
    place = first[own] + at[passage[b]] + b - (np.cumsum(many) - many)[passage[b]]
    return pa.table([pa.array(owner[own]), pa.array(name[own]), pa.array(place), pa.array(e - b + 1)], names=["doc_id", "print", "first", "size"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for text, packed_f, packed_s, more in zip(*(batch.column(k).to_pylist() for k in ("text", "firsts", "sizes", "runs"))):
            raw = text.encode()
            first = np.concatenate([np.frombuffer(b"".join(packed_f or []), np.uint32).astype(np.int64), np.array([m["first"] for m in more or []], np.int64)])
            size = np.concatenate([np.frombuffer(b"".join(packed_s or []), np.uint8).astype(np.int64), np.array([m["size"] for m in more or []], np.int64)])
            step = np.zeros(len(raw) + 1, np.int64)
            np.add.at(step, first, 1)
            np.add.at(step, first + size + LENGTH - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            out[0].append(int(gone.sum()))
            out[1].append(int((gone & np.append(True, ~gone[:-1])).sum()) if len(gone) else 0)
            out[2].append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        yield pa.record_batch([batch.column("doc_id"), pa.array([len(t.encode()) for t in batch.column("text").to_pylist()], pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _mapped(docs: DataFrame, named: DataFrame) -> DataFrame:
    """docs with maybe: false only where (doc_id, print) is surely not in named.  A map of MAP_BITS bits is broadcast."""
    place = F.pmod(F.xxhash64("doc_id", "print"), F.lit(MAP_BITS))
    bits = named.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits_"))
    found = docs.withColumn("p_", place).withColumn("bucket_", F.bitmap_bucket_number("p_")).join(F.broadcast(bits), "bucket_", "left")
    at = F.bitmap_bit_position("p_")
    byte = F.conv(F.hex(F.expr("substring(bits_, cast(bitmap_bit_position(p_) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return found.withColumn("maybe", F.coalesce((F.floor(byte / F.pow(F.lit(2), at % 8)) % 2) == 1, F.lit(False))).drop("p_", "bucket_", "bits_")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of docs (doc_id, text), extra columns ignored.

    Every byte is removed that a LENGTH-byte string covers which also starts in a document with a smaller doc_id;
    strings are judged on the input and don't cross documents.  A null or empty text has no bytes; rows with the
    same doc_id don't remove each other's strings; a row without doc_id keeps all and removes nothing.

    Equal strings have equal anchors (anchors()), by whose hash ranges gather all runs (exchange.py).  A run whose whole
    context a smaller document has is done.  Only where an anchor stands in several contexts are these
    fetched from the texts and compared, in tasks that hold all contexts of an anchor: windows whose hash no other
    document has are left out, the rest go through suffix arrays, common prefixes and a merge by binary search (least_owner()).  An anchor with over BLOCK contexts is compared by pairs of blocks.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("print", F.pmod(F.xxhash64("text"), F.lit(1 << 32)))
    usable = own.where("doc_id is not null")
    bits = range_bits(usable, "text", 0.065, RANGE_ITEMS)
    found = written(usable.mapInArrow(_send(bits, 1 << bits), _SENT).groupBy("key").applyInArrow(_meet(bits), _FOUND))
    done = found.where("alike is null").select("doc_id", "print", "firsts", "sizes")
    todo = found.where("alike is not null")
    lists = todo.groupBy("doc_id", "print").agg(*[F.collect_list(k).alias(k) for k in ("firsts", "sizes", "hashes", "alike")])
    texts = _mapped(usable, todo.select("doc_id", "print")).where("maybe").select("doc_id", "print", "text").dropDuplicates(["doc_id", "print"])
    contexts = written(texts.join(lists, ["doc_id", "print"]).mapInArrow(_contexts, "doc_id long, print long, first long, anchor long, alike long, body binary"))
    size = contexts.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = F.ceil(F.col("alike") / BLOCK).cast("int")
    dealt = contexts.withColumn("b", F.pmod(F.xxhash64("doc_id", "first"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    task = F.when(F.col("alike") <= BLOCK, F.pmod("anchor", F.lit(max(1, -(-int(size) // TASK_BYTES))))).otherwise(F.xxhash64("anchor", F.least("b", "o"), F.greatest("b", "o")))
    runs = dealt.withColumn("task", task).select("task", "doc_id", "print", "first", "body").groupBy("task").applyInArrow(_compare, "doc_id long, print long, first long, size long")
    runs = written(runs)
    named = done.select("doc_id", "print").unionByName(runs.select("doc_id", "print"))
    cover = done.groupBy("doc_id", "print").agg(F.collect_list("firsts").alias("firsts"), F.collect_list("sizes").alias("sizes"))
    other = runs.groupBy("doc_id", "print").agg(F.collect_list(F.struct("first", "size")).alias("runs"))
    marked = _mapped(own, named)
    cut = marked.where("maybe").join(cover, ["doc_id", "print"], "left").join(other, ["doc_id", "print"], "left").select("doc_id", "text", "firsts", "sizes", "runs")
    cut = cut.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    whole = marked.where("not maybe").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(whole)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_repeats": op7_repeats}
ORACLE: dict[str, str] = {}
