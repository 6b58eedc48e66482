"""Merkle manifest, content-addressed archive and lexical search against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from millrace import llm
from millrace.llm import lexical, merkle, warc

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, claim string, g int, term string, shard int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Levels of a tree, the leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def path(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        out.append((level[first:at], level[at + 1 : first + 16]))
        at //= 16
    return out


def brute_manifest(rows, claim):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), claim(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s], key=lambda x: x[:3])) for s in names}
    levels = {s: tree([x[2] for x in trees[s]]) for s in names}
    top = tree([levels[s][-1][0] for s in names]) if names else []
    out = []
    for g, s in enumerate(names):
        above = path(top, g)
        for i, (known, key, leaf, said) in enumerate(trees[s]):
            way = path(levels[s], i) + above
            cur = said or leaf
            for a, b in way:
                cur = H(*a, cur, *b)
            out.append((key if known else None, leaf, levels[s][-1][0], top[-1][0], H(*(x for a, b in way for x in a + b)), cur, cur == top[-1][0]))
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_manifest_of_given_documents(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = brute_manifest(rows, lambda r: leaf_of(r, r["text"] and r["text"].translate(lower)) if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else None)
    assert plain(llm.queries()["op11_merkle"](spark, DIR)) == want
    assert {w[-1] for w in want} == {True, False}


def test_manifest_of_odd_rows(spark):
    texts = [None, "", "a", "ü" * 70_000, "a", "line\nend"]
    rows = [(i % 5 or None, texts[i % 6], None, [None, "", "b", "ü", "Z"][i % 5], i % 3 or None, "x", "y", 1, "t", 2) for i in range(90)]
    df = spark.createDataFrame(rows + rows[:7], SCHEMA)
    rows = [r.asDict() for r in df.collect()]
    assert plain(merkle.manifest(df)) == brute_manifest(rows, lambda r: None)
    assert plain(merkle.manifest(df.repartition(3, "text"))) == brute_manifest(rows, lambda r: None)
    assert merkle.manifest(df.limit(0)).count() == 0
    assert merkle.manifest(df.limit(1)).collect()[0]["verified"]


def test_manifest_of_many_blocks(spark):
    """A group of 18 blocks (the last one short), one of exactly a block, one of a leaf more, single leaves."""
    sizes = {"hot": 17 * 4096 + 5, "block": 4096, "more": 4097, "one": 1, None: 17}
    df = None
    for s, n in sizes.items():
        own = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(s).cast("string").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.col("id").cast("string").alias("text"))
        df = own if df is None else df.unionByName(own)
    claim = F.when(F.col("doc_id") % 1000 == 7, merkle.digest(F.lit("other")))
    want = brute_manifest([r.asDict() for r in df.collect()], lambda r: H("5:other") if r["doc_id"] % 1000 == 7 else None)
    assert plain(merkle.manifest(df, claim=claim)) == want


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 20, 40, 255, 256, 257, 300, 4100])
def test_butterfly_gives_every_node_its_proof(spark, n):
    nodes = [H(str(i)) for i in range(n)]
    df = spark.createDataFrame([(7, i, n, h) for i, h in enumerate(nodes)] + [(8, 0, 1, "alone")], "g long, i long, n long, node string")
    rows = merkle.butterfly(df).where("g = 7").orderBy("i").collect()
    levels = tree(nodes)
    assert [r["i"] for r in rows] == list(range(n)) and {r["root"] for r in rows} == {levels[-1][0]}
    for r in rows[:: max(1, n // 50)]:
        assert [(u["run"][: u["place"]], u["run"][u["place"] + 1 :]) for u in r["up"]] == path(levels, r["i"])


def brute_archive(rows):
    """Rows (page_id, url, html) -> what op12 returns of them, sorted."""
    out, by = [], {}
    for k, (page, _, html) in enumerate(rows):
        by.setdefault((html or "").encode(), []).append((page is not None, page or 0, k))
    for payload, own in by.items():
        best = max(own)
        for known, page, k in own:
            sha = hashlib.sha1(payload).hexdigest()
            again = len(payload) >= 1000 and (known, page, k) != best
            out.append((page if known else None, len(payload), sha, "revisit" if again else "response", (best[1] if best[0] else None) if again else None))
    return sorted(out, key=str)


@pytest.fixture()
def pages(spark):
    long, tie, big = "<p>ä</p>" * 200, "x" * 1000, "y" * 400_000
    rows = [(i, f"http://h/{i}", long) for i in range(700)]  # more copies than meet one payload
    rows += [(1000 + i, "http://h/t", tie) for i in (3, 9, 9, 5)] + [(None, "u", tie), (None, None, "z" * 2000), (None, "v", "z" * 2000)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "http://h/\r\nPage-ID: 7", "small"), (2003, "http://h", "small"), (2004, "b", big), (2005, "b", big), (2006, "n", "x" * 999), (2007, "n", "x" * 999)]
    rows += [(2008, "h", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb" * 40), (2009, "h", "ü\x00￾")]
    return rows


def test_archive(spark, pages, tmp_path):
    df = spark.createDataFrame([(*r, "x", 1, "h") for r in pages], "page_id long, url string, html string, sha256 string, row int, head string").repartition(5)
    folder = str(tmp_path / "archive")
    warc.store(df, folder)
    found = warc.fields(warc.records(spark, folder))
    got = [(int(r["page"]) if r["page"] else None, len(r["payload"]), hashlib.sha1(bytes(r["payload"])).hexdigest(), r["record_type"], int(r["refers_to"]) if r["refers_to"] else None) for r in found.collect()]
    assert sorted(got, key=str) == brute_archive(pages)
    assert all(r["digest"] == hashlib.sha1(bytes(r["payload"])).hexdigest() for r in found.collect())
    assert found.select("record_id").distinct().count() == len(pages)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({r[2] or "" for r in pages})
    assert spark.read.parquet(f"{folder}/records").groupBy("sha256", "part").count().agg(F.max("count")).first()[0] < 2 * warc.PART
    # As files: each record as the plain reader of the format sees it, and read back.
    out = str(tmp_path / "files")
    warc.export(spark, folder, out, 100)
    seen = Counter()
    for file in (tmp_path / "files").glob("part-*"):
        data, at = file.read_bytes(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at) + 4
            size = int(re.search(rb"\r\nContent-Length: (\d+)", data[at:end])[1])
            assert data[at : at + 10] == b"WARC/1.1\r\n" and data[end + size : end + size + 4] == b"\r\n\r\n"
            http, _, payload = data[end : end + size].partition(b"\r\n\r\n")
            revisit = b"WARC-Type: revisit" in data[at:end]
            assert http.startswith(b"HTTP/1.1 200 OK\r\n") and not (revisit and payload)
            seen[data[at:end].decode() + http.decode() + "\r\n\r\n", payload] += 1
            at = end + size + 4
    whole = Counter((r["head"], b"" if r["record_type"] == "revisit" else bytes(r["payload"])) for r in found.collect())
    assert seen == whole
    assert Counter((r["head"], bytes(r["payload"])) for r in warc.read_files(spark, out).collect()) == whole


def test_archive_of_nothing_and_damage(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.store(empty, str(tmp_path / "a"))
    assert warc.records(spark, str(tmp_path / "a")).count() == 0
    warc.store(spark.createDataFrame([(1, "u", "abc")], empty.schema), str(tmp_path / "b"))
    kept = spark.read.parquet(str(tmp_path / "b/payloads"))
    kept.withColumn("payload", F.lit(zstandard.compress(b"abd"))).write.parquet(str(tmp_path / "c/payloads"))
    spark.read.parquet(str(tmp_path / "b/records")).write.parquet(str(tmp_path / "c/records"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.records(spark, str(tmp_path / "c")).collect()


def test_archive_of_given_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [tuple(r) for r in llm.queries()["op12_warc"](spark, DIR).collect()]
    assert sorted(got, key=str) == brute_archive(rows)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in TERM.findall(text or "")]


def brute_search(docs, items, k=10):
    own = [(d, Counter(terms_of(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c in own:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(i, rank + 1, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, k=10):
    found = lexical.written(lexical.index(docs))
    return sorted((tuple(r) for r in lexical.search(found, items, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_of_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in llm.queries()["op13_search"](spark, DIR).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == brute_search(docs, items) and len(got) > 300


@pytest.mark.parametrize("chars", [lexical.QUERY_CHARS, 100])
def test_search_of_odd_rows(spark, monkeypatch, chars):
    """Ties by the hundred, frequent and rare terms, lists of many blocks, several shards, null and repeated keys."""
    monkeypatch.setattr(lexical, "QUERY_CHARS", chars)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["ÄÖ", "ß", "日本", "Zz"]
    weights = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 40), p=weights / weights.sum()))) for i in range(1500)]
    docs += [(5000 + i, "same words w50 W51") for i in range(300)] + [(5000, "same words w50 W51"), (None, "same words w50 W51"), (None, "w59"), (6000, None), (6001, ""), (6002, ".,-"), (6003, "w58 " * 50_000), (6004, "every w0")]
    items = [(1, "W0 w1 w2 w3"), (2, "w59, w58; w0 ÄÖ äö"), (3, "same w50"), (4, None), (5, ""), (6, "absent"), (None, "w40 w41"), (7, "w0"), (7, "w45"), (8, " ".join(words)), (2, "w59")]
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in docs], "doc_id long, text string, term string, shard int").repartition(6)
    ask = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    assert searched(spark, df, ask) == brute_search(docs, items)
    assert searched(spark, df, ask, 3) == brute_search(docs, items, 3)
    assert searched(spark, df.limit(0), ask) == [] and searched(spark, df, ask.limit(0)) == []


def test_numbers_round_trip():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 300, 1000), rng.integers(0, 2**40, 500), np.array([0]), np.array([127, 128, 16383, 16384])):
        data, size = lexical.encode(values)
        assert size.sum() == len(data) and np.array_equal(lexical.decode(data), values)


def test_blocks_are_skipped():
    """A rare term settles the best documents; of the frequent term's blocks only those that may add to them are read."""
    shard = lexical._Shard()
    for i in range(10_000):
        shard.add(i, b"rare often" if i in (70, 71, 5000) else b"often " + b"x " * (i % 7))
    rows = {r["term"]: r for r in shard.rows(0).to_pylist()}
    n, total = rows[None]["df"], rows[None]["total"]
    scale = lambda length: 10 + (90 * length * n) // total
    lists = [lexical._List(rows[t]["df"], rows[t]["blocks"], rows[t]["impacts"], rows[t]["postings"], lexical.weight(n, rows[t]["df"]) or 1, scale) for t in ("rare", "often")]
    read = []
    for x in lists:
        x.read = lambda m, blocks=None, x=x: (read.append((x, blocks)), lexical._List.read(x, m, blocks))[1]
    m = scale(np.frombuffer(rows[None]["postings"], np.int64)[10_000:])
    found, score = lexical.best(lists, m, 3, 1)
    assert found.tolist() == [70, 71, 5000]
    assert [None if b is None else b.tolist() for _, b in read] == [None, [1, 78]] and len(lists[1].first) == 157
    for x in lists:  # bounds hold for every posting
        doc, s = lexical._List.read(x, m)
        assert (s <= x.bounds[np.searchsorted(x.last, doc)]).all()
