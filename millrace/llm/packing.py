"""Packing of documents into training sequences by an order-preserving dynamic programme."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, per_process, string_buffer, table, text_chunks

#: Tokens of a sequence.
LENGTH = 1024
#: Ranks of the same vocabulary as byte_bpe_50k.json: equal ids, several times the speed.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The tokenizer's own file, of which the added tokens are read.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Id that ends a document.
END = 0
#: What a cut costs in padding tokens: after a document, after a sentence, inside one.
DOCUMENT_CUT, SENTENCE_CUT, INNER_CUT = 0, 2, 24
#: Distance of the cuts that are offered inside a long sentence.
INNER_STEP = 64
#: Tokens that are cut together; the stream goes on in a new sequence after them.
SEGMENT_TOKENS = 1 << 20


def _load(path: str, tokenizer: str = TOKENIZER):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(tokenizer, "rb") as f:
        added = json.load(f)["added_tokens"]
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("an added token takes the text around it into account")
    special = {t["content"]: t["id"] for t in added}
    ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
    for token, i in ranks.items():
        ends[i] = token.rstrip(b" ").endswith((b".", b"!", b"?", b"\n"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), ends


_tokenizer = per_process(_load)


def _powers(places: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Pairs of places (from, to) a power of two apart, at most `length`, by the later one, longest first."""
    froms, tos, size = [], [], 1
    while size <= length:
        at = np.searchsorted(places, places - size)
        hit = np.flatnonzero(places[np.minimum(at, len(places) - 1)] == places - size)
        froms.append(at[hit])
        tos.append(hit)
        size *= 2
    froms, tos = np.concatenate(froms[::-1]), np.concatenate(tos[::-1])
    order = np.argsort(tos, kind="stable")
    return froms[order].tolist(), [*tos[order].tolist(), -1]


def cuts(sentence_ends: np.ndarray, doc_ends: np.ndarray, n: int, length: int = LENGTH) -> np.ndarray:
    """Where the stream of n tokens is cut (ends of sequences, the last is n), at the least sum of padding
    and cut costs.

    Places are document ends, sentence ends, and every INNER_STEP tokens where neither comes.
    best[j] = cost[j] + length - place[j] + min(best[i] + place[i]) over places i at most `length`
    before j: a sliding minimum, kept in a monotone queue.  A sequence of a power of two tokens needs no
    padding: from each place that far before j there is one more transition.  Ties take the longer sequence.
    """
    places = np.unique(np.concatenate([sentence_ends, doc_ends, [0, n]]))
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > INNER_STEP)
    inner = np.concatenate([np.arange(places[k] + INNER_STEP, places[k + 1], INNER_STEP) for k in wide]) if len(wide) else np.zeros(0, np.int64)
    cost = np.full(n + 1, INNER_CUT, np.int64)
    cost[sentence_ends] = SENTENCE_CUT
    cost[doc_ends] = DOCUMENT_CUT
    cost[n] = 0
    places = np.unique(np.concatenate([places, inner]))
    cost_at = cost[places].tolist()
    free_from, free_to = _powers(places, length)
    p = places.tolist()
    best, came, queue_v, queue_i, head, free = [0] * len(p), [0] * len(p), [0], [0], 0, 0
    for j in range(1, len(p)):
        at = p[j]
        while at - p[queue_i[head]] > length:
            head += 1
        i = queue_i[head]
        low = queue_v[head] + length - at
        while free_to[free] == j:
            h = free_from[free]
            free += 1
            if best[h] < low:
                low, i = best[h], h
        low += cost_at[j]
        best[j], came[j] = low, i
        v = low + at
        while len(queue_v) > head and queue_v[-1] >= v:
            queue_v.pop()
            queue_i.pop()
        queue_v.append(v)
        queue_i.append(j)
    out, j = [], len(p) - 1
    while j:
        out.append(p[j])
        j = came[j]
    return np.array(out[::-1], np.int64)


def pieces(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, start in it, tokens, sequence, offset in it, first token) of every piece of a segment."""
    n = len(ids)
    ends = cuts(np.flatnonzero(sentence_end[ids]) + 1, doc_ends, n, length)
    stop = np.unique(np.concatenate([ends, doc_ends]))
    first = np.concatenate([[0], stop[:-1]])
    doc, seq = np.searchsorted(doc_ends, first, side="right"), np.searchsorted(ends, first, side="right")
    return doc, first - np.concatenate([[0], doc_ends])[doc], stop - first, seq, first - np.concatenate([[0], ends])[seq], first


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of documents in sequences of at most `length` tokens: key, start, length, doc_tokens,
    sequence_id, offset and ids (little-endian unsigned 32-bit).

    Each partition is a stream of its own, in its order; its sequences are numbered from
    partition * 2 ** 33.  A null or empty text is the end id alone; an added token of the
    tokenizer in a text is its one id; an empty table gives no pieces; rows with equal or null keys stay apart in the
    stream and keep their key.  Extra columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sentence_end = _tokenizer((vocabulary, tokenizer), vocabulary, tokenizer)
        at = TaskContext.get().partitionId() << 33
        keys, held, size = [], [], 0

        def flush(at):
            ids = np.concatenate(held)
            doc_ends = np.cumsum([len(x) for x in held])
            doc, start, count, seq, offset, first = pieces(ids, doc_ends, sentence_end, length)
            whole = np.diff(np.concatenate([[0], doc_ends]))
            own = pa.concat_arrays([pa.array(k) for k in keys]).take(pa.array(doc))
            for s in range(0, len(doc), 20_000):
                e = s + 20_000
                flat = ids[first[s] : first[min(e, len(doc)) - 1] + count[min(e, len(doc)) - 1]]
                yield pa.record_batch([own[s:e], *(pa.array(x[s:e], pa.int64()) for x in (start, count, whole[doc], seq + at, offset)), binaries(flat, count[s:e])], names=[key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in text_chunks(batches, text):
            data, ends, starts = string_buffer(batch.column(text))
            data = data.tobytes()
            for s, e in zip(starts.tolist(), ends.tolist()):
                held.append(np.array([*encoding.encode(data[s:e].decode(), allowed_special="all"), END], np.uint32))
                size += len(held[-1])
            keys.append(batch.column(key))
            if size >= SEGMENT_TOKENS:
                made = 0
                for out in flush(at):
                    made = max(made, out.column("sequence_id")[-1].as_py() + 1)
                    yield out
                at, keys, held, size = made, [], [], 0
        if held:
            yield from flush(at)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op9_packing": op9_packing}
ORACLE: dict[str, str] = {}
