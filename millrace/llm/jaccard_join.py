"""Jaccard join on word n-grams: rare-first prefix, length, positional and suffix filters, one verification a pair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binaries, components, free, mix, string_buffer, table, text_chunks, unpack, written
from .exchange import block_columns, range_bits, unpack_hashes

#: Words of a shingle, and the least similarity in percent.
WORDS, PERCENT = 4, 85
#: Parts of the hash space in which the suffix filter counts a set's shingles.
PARTS = 16
#: Postings of an n-gram that are compared in one block; more are compared by pairs of blocks.
BLOCK = 4096
#: An n-gram that so many sets have, by a sample, goes with its sets and not to its range, whose task would hold them all.
COMMON = 200_000
#: Documents of that sample at least, and occurrences in it that tell such an n-gram.
SAMPLE_DOCS, SAMPLE_SEEN = 4000, 64
#: Postings of a task in candidate search.
TASK_POSTINGS = 100_000
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = 0x9E3779B97F4A7C15


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts on end, and the number of words of each text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1] | False
    at = starts[(starts < len(data)) & (ends > starts)]
    begins[at] = ~space[at]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    # A word's hash is the sum of (byte + 1) * base ** place, in 64 bits, over its bytes; white space adds nothing.
    word = np.cumsum(begins) - 1
    place = np.arange(len(data)) - first[np.maximum(word, 0)]
    power = np.full(int(place.max()) + 1, _BASE | 1, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    value = _LOWER[data] * power[np.maximum(place, 0)]
    value[space] = 0
    return mix(np.add.reduceat(value, first)), np.searchsorted(first, ends) - np.searchsorted(first, starts)


def shingle_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence, one without words none."""
    w, count = word_hashes(data, starts, ends)
    n = len(w)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled[: n - k] = rolled[: n - k] * np.uint64(0xD6E8FEB86659FD93) + w[k:]
    rolled = mix(rolled)
    out, at = [], 0
    for c in count.tolist():
        if c >= words:
            out.append(np.unique(rolled[at : at + c - words + 1]))
        elif c:
            short = np.uint64(c)
            for v in w[at : at + c].tolist():
                short = np.uint64((int(short) * 0xD6E8FEB86659FD93 + v) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


_SENT = "key int, doc_id long, n long, print binary, parts binary, names binary, counts binary, hashes binary"
_FOUND = "doc_id long, n long, print binary, parts binary, size int, tokens binary, freqs binary"


def common_shingles(docs: DataFrame, n_docs: int, words: int, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that about `common` sets or more have, and about how many have them, in order of the hashes.

    A sample by hashes of the texts only steers the work: any set of shingles gives the same result.  As sets hold a
    few hundred shingles, there are at most a few hundred times n_docs / common of these; `common` rises with the
    input so that a million fit.
    """
    share = min(1.0, max(SAMPLE_DOCS / max(n_docs, 1), SAMPLE_SEEN / common))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            sets = shingle_sets(*(lambda d, e, s: (d, s, e))(*string_buffer(batch.column("text"))), words)
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    seen = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, int(share * common)))
    rows = seen.orderBy(F.desc("n"), "h").limit(1 << 20).collect()
    h, n = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] / share for r in rows])
    order = np.argsort(h)
    return h[order], np.minimum(n[order], 2**31).astype(np.uint32)


def _send(bits: int, salts: int, words: int, common):
    """Of each text: its id, set size, print of its set, counts by part and common shingles; and blocks of the others by range."""
    kinds = {"key": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "print": pa.binary(), "parts": pa.binary(), "names": pa.binary(), "counts": pa.binary(), "hashes": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            sets = shingle_sets(*(lambda d, e, s: (d, s, e))(*string_buffer(batch.column("text"))), words)
            n = np.array([len(s) for s in sets], np.int64)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            parts = np.stack([np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) for s in sets]).astype(np.uint32)
            # Rows of documents only pass; their place in the table deals them, as copies have one print.
            key = -1 - ((np.arange(len(sets)) + int(parts.sum() % (1 << 30))) % salts).astype(np.int32)
            known, weight = common.value
            own = [np.zeros(len(x), bool) if not len(known) else known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x for x in sets]
            held = np.concatenate([x[o] for x, o in zip(sets, own)])
            many = np.array([o.sum() for o in own])
            none = pa.nulls(len(sets), pa.binary())
            yield pa.record_batch([pa.array(key), batch.column("doc_id"), pa.array(n), pa.array(prints, pa.binary()), binaries(parts.reshape(-1), np.full(len(sets), PARTS)), none, binaries(weight[np.searchsorted(known, held)], many), binaries(held, many)], names=list(kinds))
            sets, n = [x[~o] for x, o in zip(sets, own)], n - many
            full = np.flatnonzero(n)
            if len(full):
                names = np.frombuffer(b"".join(prints[i] for i in full), np.uint8).reshape(-1, 16)
                block = block_columns(np.concatenate([sets[i] for i in full]), np.repeat(np.arange(len(full)), n[full]), names, bits)
                m = len(block[0])
                yield pa.record_batch([block[0], *(pa.nulls(m, kinds[k]) for k in ("doc_id", "n", "print", "parts")), *block[1:]], names=list(kinds))

    return run


def _meet(bits: int):
    """Document rows pass; of a range, the shingles that two different sets have, with the number of such sets."""

    def run(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        names = ["doc_id", "n", "print", "parts", "size", "tokens", "freqs"]
        if key[0].as_py() < 0:
            rows = found.select(["doc_id", "n", "print", "parts"])
            return pa.table([*rows.columns, pa.nulls(len(rows), pa.int32()), found.column("hashes"), found.column("counts")], names=names)
        who = unpack(found.column("names"), np.uint8)[0].reshape(-1, 16)
        counts = unpack(found.column("counts"), np.uint32)[0]
        h = unpack_hashes(unpack(found.column("hashes"), np.uint8)[0], key[0].as_py(), bits)
        halves = np.ascontiguousarray(who).view(np.uint64).reshape(-1, 2)
        order = np.lexsort((np.arange(len(who)), halves[:, 1], halves[:, 0]))
        first = np.ones(len(who), bool)  # equal sets count once
        first[order[1:]] = (halves[order[1:]] != halves[order[:-1]]).any(1)
        doc = np.repeat(np.arange(len(who)), counts)
        keep = first[doc]
        h, doc = h[keep], doc[keep]
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        begins = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        freq = np.repeat(np.diff(np.append(begins, len(h))), np.diff(np.append(begins, len(h))))
        shared = freq >= 2
        h, doc, freq = h[shared], doc[shared], freq[shared]
        order = np.argsort(doc, kind="stable")
        h, freq = h[order], freq[order]
        size = np.bincount(doc, minlength=len(who))
        own = np.flatnonzero(size)
        none = pa.nulls(len(own), pa.int64())
        return pa.table([none, none, binaries(np.ascontiguousarray(who[own]).reshape(-1), np.full(len(own), 16)), pa.nulls(len(own), pa.binary()), pa.array(size[own].astype(np.int32)), binaries(h, size[own]), binaries(freq.astype(np.uint32), size[own])], names=names)

    return run


def _prefix(percent: int):
    """Of each set: its shared shingles (token null), and its prefix's shared shingles with their positions.

    The order of shingles is by frequency, then hash, which is the same for all sets; those that no other
    set has come first and need no posting.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("token", "rep", "n", "pos", "freq", "parts", "tokens")}
            for rep, n, parts, tokens, freqs in zip(*(batch.column(k).to_pylist() for k in ("rep", "n", "parts", "tokens", "freqs"))):
                t = np.frombuffer(b"".join(tokens), np.uint64)
                f = np.frombuffer(b"".join(freqs), np.uint32)
                order = np.lexsort((t, f))
                alone = n - len(t)
                take = n - (percent * n + 99) // 100 + 1 - alone
                out["token"].append(np.concatenate([[0], t[order[:take]].view(np.int64)]))
                out["pos"].append(np.concatenate([[-1], alone + np.arange(take)])[: 1 + len(t)])
                out["freq"].append(np.concatenate([[0], f[order[:take]]]))
                k = len(out["token"][-1])
                out["rep"].append(np.full(k, rep))
                out["n"].append(np.full(k, n))
                out["parts"] += [parts] * k
                out["tokens"] += [np.sort(t).tobytes(), *[None] * (k - 1)]
            if out["rep"]:
                num = {k: np.concatenate(out[k]).astype(np.int64) for k in ("token", "rep", "n", "pos", "freq")}
                yield pa.record_batch([*(pa.array(v) for v in num.values()), pa.array(out["parts"], pa.binary()), pa.array(out["tokens"], pa.binary())], names=["token", "rep", "n", "pos", "freq", "parts", "tokens"])

    return run


def _fits(n, pos, parts, x, y, percent: int) -> np.ndarray:
    """Whether pairs pass the filters: length; position, as if this were their first common n-gram; suffix, as no
    part of the hash space can give more common n-grams than the smaller count there."""
    nx, ny = n[x], n[y]
    need = -(-percent * (nx + ny) // (100 + percent))
    ok = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
    ok &= 1 + np.minimum(nx - pos[x], ny - pos[y]) - 1 >= need
    at = np.flatnonzero(ok)
    ok[at] = np.minimum(parts[x[at]], parts[y[at]]).sum(1) >= need[at]
    return ok


def _candidates(percent: int, across: bool):
    """Pairs (a < b) of sets that share a prefix n-gram and pass the filters.

    First round: each posting with the first of its n-gram and with the one before it.  Second round
    (across): all postings of an n-gram whose sets are not yet in one component.
    """

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        get = lambda k: rows.column(k).to_numpy()
        group = mix(get("token").view(np.uint64)) ^ mix(get("i").astype(np.uint64) * np.uint64(1 << 32) + get("j").astype(np.uint64) + np.uint64(1))
        order = np.lexsort((get("rep"), get("n"), get("pos"), group))
        group, rep, n, pos, comp, side = group[order], get("rep")[order], get("n")[order], get("pos")[order], get("comp")[order], (get("own") == get("i"))[order]
        cross = (get("i") != get("j"))[order]
        parts = unpack(rows.column("parts"), np.uint32)[0].reshape(-1, PARTS)[order]
        every = np.arange(len(group))
        pairs: list[np.ndarray] = []

        def offer(x, y):
            use = (comp[x] != comp[y]) & (rep[x] != rep[y]) & (~cross[x] | (side[x] != side[y]))
            x, y = x[use], y[use]
            ok = _fits(n, pos, parts, x, y, percent)
            a, b = rep[x[ok]], rep[y[ok]]
            pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            if sum(map(len, pairs)) > 1 << 20:
                pairs[:] = [np.unique(np.concatenate(pairs), axis=0)]

        if not across:
            first = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), every, 0)) if len(every) else every
            offer(first[first < every], every[first < every])
            near = every[1:][first[1:] < every[1:] - 1]
            offer(near - 1, near)
        else:
            step, left = 1, every[:-1]
            while len(left := left[left + step < len(group)]) and len(left := left[group[left] == group[left + step]]):
                offer(left, left + step)
                step += 1
        found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y, n, m) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("ta", "tb", "na", "nb")))):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                good[i] = 100 * both >= percent * (n + m - both)
            yield pa.record_batch([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["u", "v"])

    return run


def join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, common: int = COMMON) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text), extra columns ignored.

    A set is the distinct `words`-word shingles of a text (white space parts words, A-Z counts as a-z);
    a text of fewer words has its whole sequence as one; a null, empty or blank text has the empty set
    and links with nothing, nor does a row without doc_id (component_id null).  Two texts link if 100 *
    intersection >= percent * union; component_id is the least doc_id reachable over links.  Equal sets
    count once throughout (the least doc_id stands for them), so copies are never paired.

    Shingles are counted exactly over all sets (exchange.py), but for those that some `common` sets or more have: these
    stay with their sets and take their number from a sample, as the order of rare-first need only be the same for all.  A set whose prefix holds only shingles that no
    other set has can't link and drops out; the others post the shared shingles of their prefix.
    Candidates are verified once each, on the shared shingles.  A first round verifies a few pairs for
    every posting; a second all remaining pairs of sets that are not in one component by then, so no
    component is missed, and a group of near copies costs about its size.  An n-gram with over BLOCK
    postings is compared by pairs of blocks.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bits = range_bits(own, "text", 0.17)
    n_docs = own.count()
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(own, n_docs, words, max(common, n_docs // 3000)))
    found = written(own.mapInArrow(_send(bits, 1 << bits, words, shared), _SENT).groupBy("key").applyInArrow(_meet(bits), _FOUND))
    rows = found.where("size is null").select("doc_id", "n", "print", "parts")
    named = found.where("size is null and print is not null and doc_id is not null")
    reps = named.groupBy("print").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("parts").alias("parts"), F.min("tokens").alias("own"), F.min("freqs").alias("own_freqs"))
    pieces = found.where("size is not null").groupBy("print").agg(F.sum("size").alias("s"), F.collect_list("tokens").alias("tokens"), F.collect_list("freqs").alias("freqs"))
    # pmod is the part of percent * n below a whole hundred: n - ceil(percent * n / 100) + 1 is the prefix.
    size = F.coalesce("s", F.lit(0)) + F.length("own") / 8
    both = lambda lists, own: F.concat(F.coalesce(lists, F.expr("cast(array() as array<binary>)")), F.array(own))
    near = reps.join(pieces, "print", "left").select("rep", "n", "parts", size.cast("long").alias("s"), both("tokens", "own").alias("tokens"), both("freqs", "own_freqs").alias("freqs"))
    near = near.where(F.expr(f"n - s < n - ({percent} * n + 99) div 100 + 1"))
    posted = written(near.select("rep", "n", "parts", "tokens", "freqs").mapInArrow(_prefix(percent), "token long, rep long, n long, pos long, freq long, parts binary, tokens binary"))
    sets = posted.where("pos < 0").select("rep", "n", "tokens")
    postings = posted.where("pos >= 0").select("token", "rep", "n", "pos", "freq", "parts")
    links = _round(postings.withColumn("comp", F.col("rep")), sets, percent, False)
    first = components(links)
    labelled = postings.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    # Only n-grams whose postings are in several components are left.
    open_ = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    more = _round(labelled.join(open_, "token"), sets, percent, True)
    tree = first.select(F.col("node").alias("u"), F.col("component").alias("v"))
    joined = components(tree.unionByName(more))
    labels = reps.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(labels, "print", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _round(postings: DataFrame, sets: DataFrame, percent: int, across: bool) -> DataFrame:
    """Verified links (u, v) among the candidates of one round."""
    blocks = F.ceil(F.col("freq") / BLOCK).cast("int")
    own = postings.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = own.withColumn("i", F.least("own", "o")).withColumn("j", F.greatest("own", "o")).drop("o")
    tasks = F.lit(max(8, 1 + postings.count() // TASK_POSTINGS))
    dealt = own.withColumn("task", F.pmod(F.xxhash64("token", "i", "j"), tasks).cast("int")).select("task", "token", "i", "j", "own", "rep", "n", "pos", "comp", "parts")
    pairs = dealt.groupBy("task").applyInArrow(_candidates(percent, across), "a long, b long").distinct()
    a = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return written(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(_verify(percent), "u long, v long"))


def deduplicate(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of docs of which no other in their component has a smaller doc_id; of rows with that id, one.

    Rows without doc_id stay.
    """
    found = join(docs, percent, words).where("doc_id = component_id").select("doc_id").distinct()
    (rank,) = free(docs.columns, "rank")
    order = Window.partitionBy("doc_id").orderBy(*[F.xxhash64(F.col(f"`{c}`")) for c in docs.columns])
    kept = docs.join(found, "doc_id", "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return kept.unionByName(docs.where("doc_id is null"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard": op8_jaccard}
ORACLE = {
    "op8_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 3], ' ') as g from w, unnest(range(1, greatest(2, len(w) - 2))) as r(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
f as (select g from s group by g having count(*) > 1),
t as (select s.doc_id, s.g from s join f using (g)),
o as (select a.doc_id as a, b.doc_id as b, count(*) as k from t a join t b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
p as (select a, b from l union all select b, a from l),
c as (select doc_id as node, doc_id as reach from documents union select c.node, p.b from c join p on c.reach = p.a),
m as (select node, min(reach) as component_id from c group by node)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.component_id
from w left join n using (doc_id) join m on m.node = w.doc_id""",
}
