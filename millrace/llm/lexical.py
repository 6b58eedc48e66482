"""Ranked lexical search: an index of compressed blocks in shards, searched by Block-Max MaxScore."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binaries, string_buffer, table, text_chunks, written
from .decontaminate import words

#: Documents and postings of a shard at most (a document of more postings stands alone).
SHARD_DOCS, SHARD_POSTINGS = 16_384, 2_000_000
#: Tasks of a search at most; with more shards, a task has several.
TASKS = 50_000
#: Postings of a block.
BLOCK = 64
#: Characters of queries that go to the tasks at once; more queries take more passes over the index.
QUERY_CHARS = 4_000_000

_INDEX = "shard long, term string, df long, total long, blocks binary, impacts binary, postings binary"
_NAMES = ["shard", "term", "df", "total", "blocks", "impacts", "postings"]


# -- Numbers of 7 bits a byte, the last one below 128.


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each value) of non-negative numbers."""
    size = 1 + sum((values >> s > 0).astype(np.int64) for s in range(7, 64, 7))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[(ends - size)[own] + k] = (values[own] >> (7 * k)) & 127 | np.where(size[own] > k + 1, 128, 0)
    return out, size


def decode(data: np.ndarray) -> np.ndarray:
    last = data < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


# -- The index.


class _Shard:
    """The documents of a shard that is being filled."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.nulls, self.lengths = array.array("q"), bytearray(), array.array("q")
        self.terms, self.tfs, self.held = array.array("i"), array.array("q"), array.array("q")

    def add(self, doc: int | None, text: bytes) -> None:
        w = words(text)
        own = Counter(w)
        self.ids.append(doc or 0)
        self.nulls.append(doc is None)
        self.lengths.append(len(w))
        self.terms.extend(map(self.number.__getitem__, own))
        self.tfs.extend(own.values())
        self.held.append(len(own))

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.terms) >= SHARD_POSTINGS

    def rows(self, shard: int) -> pa.RecordBatch:
        """The row of the documents (no term): ids, nulls and lengths; then a row a term."""
        length = np.array(self.lengths, np.int64)
        docs = np.array(self.ids, np.int64).tobytes() + length.tobytes()
        out = [[None], [int((length > 0).sum())], [int(length.sum())], [bytes(self.nulls)], [b""], [docs]]
        head = pa.record_batch([pa.array([shard]), *(pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())))], names=_NAMES)
        if not len(self.terms):
            return head
        order = np.argsort(np.array(self.terms, np.int32), kind="stable")
        term, tf = np.array(self.terms, np.int64)[order], np.array(self.tfs, np.int64)[order]
        doc = np.repeat(np.arange(len(length)), np.array(self.held, np.int64))[order]
        df = np.bincount(term)
        first = np.cumsum(df) - df
        begins = (np.arange(len(term)) - np.repeat(first, df)) % BLOCK == 0
        start = np.flatnonzero(begins)
        block = np.cumsum(begins) - 1
        n_blocks = -(-df // BLOCK)
        delta = np.diff(doc, prepend=0)
        delta[start] = 0
        data, size = encode(np.stack([delta, tf - 1], 1).reshape(-1))
        size = np.add.reduceat(size, 2 * start)
        own = np.repeat(np.arange(len(df)), n_blocks)
        total = np.add.reduceat(size, np.cumsum(n_blocks) - n_blocks)
        ends = np.cumsum(size) - np.repeat(np.cumsum(total) - total, n_blocks)
        blocks = np.stack([doc[start], doc[np.append(start[1:], len(doc)) - 1], ends], 1).astype(np.int32)
        # What a block's best posting may be: pairs of a count and the least length with it that no other pair beats.
        order = np.lexsort((length[doc], -tf, block))
        least = length[doc][order] - block[order] * (int(length.max()) + 1)
        best = np.append(True, least[1:] < np.minimum.accumulate(least)[:-1])
        pick = order[best]
        first_block = np.cumsum(n_blocks) - n_blocks
        impacts = np.stack([block[pick] - first_block[term[pick]], tf[pick], length[doc[pick]]], 1).astype(np.int32)
        body = [
            pa.array(np.full(len(df), shard)), pa.array(list(self.number), pa.binary()).cast(pa.string()), pa.array(df.astype(np.int64)), pa.array(np.bincount(term, weights=tf).astype(np.int64)),
            binaries(blocks.reshape(-1), 3 * n_blocks), binaries(impacts.reshape(-1), 3 * np.bincount(term[pick], minlength=len(df))), binaries(data, np.bincount(own, weights=size, minlength=len(df)).astype(np.int64)),
        ]
        return pa.Table.from_batches([head, pa.record_batch(body, names=_NAMES)]).combine_chunks().to_batches()[0]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, own = TaskContext.get().partitionId() << 32, _Shard()
    for batch in text_chunks(batches, "text"):
        data, ends, starts = string_buffer(batch.column("text"))
        data = data.tobytes()
        for doc, s, e in zip(batch.column("doc").to_pylist(), starts.tolist(), ends.tolist()):
            own.add(doc, data[s:e])
            if own.full():
                yield own.rows(shard)
                shard, own = shard + 1, _Shard()
    if len(own.ids):
        yield own.rows(shard)


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of every row of docs, to be written and searched: a row a shard and term, and one for a shard's documents.

    A row holds the term's postings in the shard, in blocks of BLOCK that are compressed one by one, and of each block
    the first and last document and the pairs of count and length that bound its scores for any collection (so shards
    can be added later).  Documents stay where they are read; a shard is a run of them in one task, of bounded size.

    Texts are taken whole; null and empty ones have no terms, but their documents are kept; rows with one key, or
    without, are documents of their own.  The key is a whole number.  An empty table gives an empty index; extra columns
    are not read.
    """
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(_index, _INDEX)


# -- The search.


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class _List:
    """A term's postings in a shard, and upper bounds of their scores."""

    def __init__(self, df: int, blocks: bytes, impacts: bytes, postings: bytes, factor: int, scale) -> None:
        self.df, self.factor = df, factor
        self.first, self.last, self.end = np.frombuffer(blocks, np.int32).reshape(-1, 3).T.astype(np.int64)
        block, tf, length = np.frombuffer(impacts, np.int32).reshape(-1, 3).T.astype(np.int64)
        self.bounds = np.zeros(len(self.first), np.int64)
        np.maximum.at(self.bounds, block, self.score(tf, scale(length)))
        self.bound = int(self.bounds.max())
        self.data = np.frombuffer(postings, np.uint8)

    def score(self, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.factor * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))

    def read(self, m: np.ndarray, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the blocks, by default of all; only these are decompressed."""
        if blocks is None:
            blocks, data = np.arange(len(self.first)), self.data
        else:
            begin = np.where(blocks > 0, self.end[blocks - 1], 0)
            data = np.concatenate([self.data[s:e] for s, e in zip(begin.tolist(), self.end[blocks].tolist())])
        delta, tf = decode(data).reshape(-1, 2).T
        held = np.where(blocks == len(self.first) - 1, self.df - BLOCK * (len(self.first) - 1), BLOCK)
        doc = np.cumsum(delta)
        start = np.cumsum(held) - held
        doc += np.repeat(self.first[blocks] - doc[start], held)
        return doc, self.score(tf + 1, m[doc])


def best(lists: list[_List], m: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) that may be among the k best of a shard with a score of floor or more, by Block-Max MaxScore.

    Lists go by their bound.  The essential ones are read whole, until the bounds of those that remain cannot reach the
    k-th score found so far: no other document can then be among the best.  For the rest, a candidate's score and the
    bounds of the blocks that it would be in decide whether any is decompressed.
    """
    lists = sorted(lists, key=lambda x: -x.bound)
    rest = sum(x.bound for x in lists)
    score = np.zeros(len(m), np.int64)
    at = 0

    def raised(found: np.ndarray, floor: int) -> int:
        return max(floor, int(np.partition(found, len(found) - k)[len(found) - k])) if len(found) >= k else floor

    while at < len(lists) and rest >= floor:
        doc, s = lists[at].read(m)
        score[doc] += s
        rest -= lists[at].bound
        at += 1
        floor = raised(score, floor)
    found = np.flatnonzero(score + rest >= floor) if at else np.zeros(0, np.int64)
    found = found[score[found] > 0]
    lists = lists[at:]
    if lists and len(found):
        place = [np.searchsorted(x.last, found) for x in lists]
        inside = [p < len(x.last) for p, x in zip(place, lists)]
        place = [np.where(i, p, 0) for p, i in zip(place, inside)]
        inside = [i & (x.first[p] <= found) for x, p, i in zip(lists, place, inside)]
        bounds = [np.where(i, x.bounds[p], 0) for x, p, i in zip(lists, place, inside)]
        may = np.sum(bounds, 0)
        stays = score[found] + may >= floor
        for x, p, i, b in zip(lists, place, inside, bounds):
            blocks = np.unique(p[stays & i])
            if len(blocks):
                doc, s = x.read(m, blocks)
                score[doc] += s
            may -= b
            floor = raised(score[found[stays]], floor)
            stays &= score[found] + may >= floor
        found = found[stays]
    found = found[score[found] >= max(floor, 1)]
    return found, score[found]


def _search(shared, k: int, kind: pa.DataType):
    """The k best of every query over the shards of a task; shards of a task share the scores reached so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, factors, n, total = shared.value
        heaps: list[list[tuple]] = [[] for _ in queries]
        scale = lambda length: 10 + (90 * length * n) // total

        def finish(docs: tuple[bytes, bytes], lists: dict[str, _List]) -> None:
            null, flat = np.frombuffer(docs[0], np.uint8), np.frombuffer(docs[1], np.int64).reshape(2, -1)
            m = scale(flat[1])
            for heap, (_, terms) in zip(heaps, queries):
                own = [lists[t] for t in terms if t in lists]
                if not own:
                    continue
                found, score = best(own, m, k, heap[-1][0] * -1 if len(heap) == k else 1)
                if len(found):
                    order = np.lexsort((flat[0][found], null[found], -score))[:k]
                    heap[:] = sorted([*heap, *zip((-score[order]).tolist(), null[found][order].tolist(), flat[0][found][order].tolist())])[:k]

        shard, docs, lists = None, None, {}
        for batch in batches:
            for s, term, df, blocks, impacts, postings in zip(*(batch.column(c).to_pylist() for c in ("shard", "term", "df", "blocks", "impacts", "postings"))):
                if s != shard:
                    if shard is not None:
                        finish(docs, lists)
                    shard, lists = s, {}
                if term is None:
                    docs = blocks, postings
                else:
                    lists[term] = _List(df, blocks, impacts, postings, factors[term], scale)
        if shard is not None:
            finish(docs, lists)
        rows = [(item, None if null else doc, -score) for (item, _), heap in zip(queries, heaps) for score, null, doc in heap]
        yield pa.record_batch([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc", "score"])

    return run


def search(found: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, key, score): the k best documents of a written index() for each item of queries, scores above 0 only.

    Equal scores rank by ascending key, a null key last.  An item's terms count once each, those of all rows with its
    id together; a null id is an item of its own; a null, empty or wordless text finds nothing; no queries or an empty
    index give no rows; extra columns are not read.

    The number of documents with terms, of terms, and of documents with a term are sums over the whole index.  Only the
    lists of terms that queries have leave it, and are dealt by shard.  Each task keeps the k best of an item over its
    shards, so at most k rows an item and task meet in the end.  Queries are taken in blocks of QUERY_CHARS.
    """
    spark = found.sparkSession
    kind = queries.schema[item].dataType
    arrow = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    shards, n, total = found.where("term is null").agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    size = queries.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = 1 + int(size) // QUERY_CHARS
    out = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == b)
        terms: dict = defaultdict(dict)
        for name, value in own.select(item, text).collect():
            terms[name] |= dict.fromkeys(w.decode() for w in words((value or "").encode()))
        asked = spark.createDataFrame([(t,) for t in sorted(set().union(*terms.values()))], "term string")
        lists = found.join(F.broadcast(asked), "term", "left_semi")
        factors = {r["term"]: weight(n, r["df"]) for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        ready = [(name, [t for t in own if t in factors]) for name, own in terms.items()]
        shared = spark.sparkContext.broadcast((ready, factors, n, max(total, 1)))
        dealt = found.where("term is null").unionByName(lists.select(*_NAMES)).repartition(min(max(shards, 1), TASKS), "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        part = dealt.drop("total").mapInArrow(_search(shared, k, arrow), f"item {kind.simpleString()}, doc long, score long")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())).alias("rank")
    return out.select(F.col("item").alias(item), rank, F.col("doc").alias(key), "score").where(F.col("rank") <= k)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(index(table(spark, sf_dir, "documents")))
    return search(found, table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op13_search": op13_search}
ORACLE = {
    "op13_search": f"""
with d as (select doc_id, {_SQL_TERMS} as t from documents),
s as (select count(*) as n_docs, cast(sum(len(t)) as bigint) as n_terms from d where len(t) > 0),
tf as (select doc_id, term, count(*) as tf, max(n) as n from (select doc_id, len(t) as n, unnest(t) as term from d) group by doc_id, term),
q as (select distinct item_id, unnest({_SQL_TERMS}) as term from benchmark),
w as (select term, cast(floor(1000 * ln(cast(2 * max(n_docs) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf, s where term in (select term from q) group by term),
r as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) as bigint) as score
      from q join w using (term) join tf using (term), s group by item_id, doc_id)
select item_id, cast(rank as int) as rank, doc_id, score from
  (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0) where rank <= 10""",
}
