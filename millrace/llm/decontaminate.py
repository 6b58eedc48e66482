"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, per_process, string_buffer, table, text_chunks

#: Words in a window; a shorter item is one window.
WINDOW = 13
#: Characters of window text in one automaton.  A larger benchmark is split into several by item, and the texts are scanned once for each.
AUTOMATON_CHARS = 8_000_000
#: Bytes that part words, and A-Z to a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A word in the original text, where A-Z has not been lowered.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(items: list[tuple[str, str | None]]) -> dict[str, tuple[int, list[str]]]:
    """Window as ' w1 w2 ... ' -> (its words, ids of the items that hold it)."""
    found: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        w = words((text or "").encode())
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            part = w[i : i + WINDOW]
            own = found.setdefault(f" {b' '.join(part).decode('latin-1')} ", (len(part), []))[1]
            if not own or own[-1] != item:
                own.append(item)
    return found


def _automaton(found: dict) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    for k, v in found.items():
        a.add_word(k, v)
    if found:
        a.make_automaton()
        return a
    return None


_built = per_process(_automaton)


def _hits(text: bytes, automaton) -> tuple[int, np.ndarray | None, set[str]]:
    """Number of words, flags of hit words (None: none), items."""
    w = words(text)
    if automaton is None or not w:
        return len(w), None, set()
    line = f" {b' '.join(w).decode('latin-1')} "
    items: set[str] = set()
    ends, sizes = [], []
    for end, (n, own) in automaton.iter(line):
        ends.append(end)
        sizes.append(n)
        items.update(own)
    if not ends:
        return len(w), None, items
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, ends)  # words that end before this place
    step = np.zeros(len(w) + 1, np.int64)
    np.add.at(step, last - np.array(sizes), 1)
    np.add.at(step, last, -1)
    return len(w), np.cumsum(step[:-1]) > 0, items


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words in the original text, in code points."""
    out: list[dict] = []
    before = False
    for m, h in zip(_WORD.finditer(text), hit):
        if h and before:
            out[-1]["end"] = m.end()
        elif h:
            out.append({"start": m.start(), "end": m.end()})
        before = bool(h)
    return out


_ADDED = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"
_NAMES = ("n_words", "n_hit", "items", "spans", "contaminated")


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a window), items (ids of the items that
    occur, sorted as strings), spans (runs of hit words in the original, code points) and contaminated
    (n_hit > 0 and 20 * n_hit >= n_words).

    A null or empty text has no words; a null item id counts as 'null', a null or wordless item has no
    window; repeated items count once; an empty benchmark marks nothing.  Columns of docs with one of
    the added names are replaced, all others stay.  The windows of a block of the benchmark are
    broadcast; blocks are cut by measured size (AUTOMATON_CHARS), so this stays bounded.
    """
    spark = docs.sparkSession
    docs = docs.drop(*_NAMES)
    held = free(docs.columns, "flags", "found")
    size = benchmark.agg(F.sum(F.length(item_text) * WINDOW)).first()[0] or 0
    blocks = 1 + int(size) // AUTOMATON_CHARS
    columns = docs.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs
    for k in range(blocks):
        own = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == k)
        items = sorted((str(r[0]) if r[0] is not None else "null", r[1] or "") for r in own.select(item_id, item_text).collect())
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(windows(items)), text, columns, k == 0, k == blocks - 1, held), f"{ddl}, {_ADDED if k == blocks - 1 else f'{held[0]} binary, {held[1]} array<string>'}")
    return out


def _pass(shared, text: str, columns: list[str], first: bool, last: bool, held: list[str]):
    """The scan for one block; flags and items of earlier blocks come in the columns `held`."""
    flags_, items_ = held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built(shared.id if hasattr(shared, "id") else id(shared), shared.value)
        for batch in text_chunks(batches, text, 8 << 20):
            data, ends, starts = string_buffer(batch.column(text))
            data = data.tobytes()
            rows: dict[str, list] = {k: [] for k in (*_NAMES, flags_, items_)}
            for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
                n, hit, items = _hits(data[s:e], automaton)
                if not first:
                    was = np.frombuffer(batch.column(flags_)[i].as_py(), np.uint8).astype(bool)
                    hit = was if hit is None else hit | was if len(was) else hit
                    items |= set(batch.column(items_)[i].as_py())
                    hit = hit if hit is not None and hit.any() else None
                if last:
                    n_hit = int(hit.sum()) if hit is not None else 0
                    for k, v in zip(_NAMES, (n, n_hit, sorted(items), _spans(data[s:e].decode(), hit) if n_hit else [], 20 * n_hit >= n and n_hit > 0)):
                        rows[k].append(v)
                else:
                    rows[flags_].append(b"" if hit is None else hit.astype(np.uint8).tobytes())
                    rows[items_].append(sorted(items))
            kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "contaminated": pa.bool_()} if last else {flags_: pa.binary(), items_: pa.list_(pa.string())}
            yield pa.record_batch([batch.column(c) for c in columns] + [pa.array(rows[k], t) for k, t in kinds.items()], names=[*columns, *kinds])

    return run


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = scan(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op10_decontaminate": op10_decontaminate}
_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op10_decontaminate": f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, {_SQL_WORDS} as w from benchmark),
bw as (select distinct item_id, array_to_string(w[i : i + 12], ' ') as s, least(len(w), 13) as k
       from b, unnest(range(1, greatest(2, len(w) - 11))) as r(i) where len(w) > 0),
ks as (select distinct k from bw),
dw as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as s
       from d, ks, unnest(range(1, len(w) - k + 2)) as r(i) where len(w) >= k),
hit as (select doc_id, i, dw.k as k, item_id from dw join bw on dw.s = bw.s and dw.k = bw.k),
hw as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, i, k from hit), unnest(range(i, i + k)) as r(p) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as s from (select distinct doc_id, cast(item_id as varchar) as x from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hw using (doc_id) left join it using (doc_id)""",
}
