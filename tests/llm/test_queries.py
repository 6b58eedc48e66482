"""The registered queries, and each pipeline stage, over whole small tables against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace import llm
from millrace.llm import packing, quality, secret_scan

DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs():
    df = pd.read_parquet(f"{DIR}/documents.parquet")
    return {int(i): t or "" for i, t in zip(df["doc_id"], df["text"])}


def rows_of(spark, name, key="doc_id"):
    rows = llm.queries()[name](spark, DIR).collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def personal(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def secrets(text):
    names = ["assign", "access", "hex"]
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], names.index(x[0])))


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op2_pii", personal, ("email", "ip", "card", "phone")), ("op4_secrets", secrets, ("assign", "access", "hex"))])
def test_spans(spark, docs, name, plain, kinds):
    got = rows_of(spark, name)
    assert set(got) == set(docs)
    for i, t in docs.items():
        want = plain(t)
        assert got[i]["base_sha256"] == digest(want)
        assert all(got[i][f"n_{k}"] == sum(w[0] == k for w in want) for k in kinds)
        listed = [s.rsplit(":", 2) for s in got[i]["spans"].split(",") if s]
        assert {(k, int(s), int(e)) for k, s, e in listed} >= set(want)
        assert all(0 <= int(s) < int(e) <= len(t) for _, s, e in listed)


def test_shards(spark, docs):
    got = rows_of(spark, "op5_sharding")
    assert set(got) == set(docs)
    slots = {}
    for i, t in docs.items():
        r = got[i]
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 16, zlib.crc32(t.encode()))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len({r["law"] for r in got.values()}) == 1 and got[next(iter(got))]["law"] == "rows"
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, [])) for s in range(40)]
    assert max(counts) - min(counts) <= 1


def test_quality_held_out(spark, docs):
    got = rows_of(spark, "op6_quality")
    assert set(got) == set(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    # The small table holds out three documents of label 0; the next one has enough to judge by.
    larger = DIR.replace("sf0.001", "sf0.01")
    score = {r["doc_id"]: r["score"] for r in llm.queries()["op6_quality"](spark, larger).where("held_out").collect()}
    labels = pd.read_parquet(f"{larger}/labels.parquet").dropna(subset=["quality"])
    own = [(score[i], q) for i, q in zip(labels["doc_id"], labels["quality"]) if i in score]
    good, bad = np.array([s for s, q in own if q == 1]), np.array([s for s, q in own if q == 0])
    assert ((good[:, None] > bad) + 0.5 * (good[:, None] == bad)).mean() > 0.95
    assert (good >= 0.3).mean() > 0.95 and (bad < 0.3).mean() > 0.7


def test_repeats(spark, docs):
    first, got = {}, rows_of(spark, "op7_repeats")
    assert set(got) == set(docs)
    for i in sorted(docs):
        b = docs[i].encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-1])[: len(b)]).sum())
        kept = np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def groups(texts, words, percent):
    sets, label, meets = {i: shingles(t, words) for i, t in texts.items()}, {i: i for i in texts}, {}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in sets.items():
        for g in s:
            meets.setdefault(g, []).append(i)
    for a, b in {(m[x], m[y]) for m in meets.values() for x in range(len(m)) for y in range(x + 1, len(m))}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            label[y] = x
    return sets, {i: top(i) for i in texts}


def test_near_copies(spark, docs):
    got = rows_of(spark, "op8_jaccard")
    sets, label = groups(docs, 4, 85)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), label[i]) for i in docs}


def items():
    df = pd.read_parquet(f"{DIR}/benchmark.parquet")
    return list(zip(df["item_id"], [t or "" for t in df["text"]]))


def contaminated(texts):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    windows = {}
    for i, t in items():
        w = cut(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    sizes, out = {len(k) for k in windows}, {}
    for d, t in texts.items():
        w, found = cut(t), set()
        hit = np.zeros(len(w), bool)
        for size in sizes:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    found |= own
                    hit[k : k + size] = True
        n = int(hit.sum())
        out[d] = (len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w))
    return out


def test_benchmark_windows(spark, docs):
    got = rows_of(spark, "op10_decontaminate")
    assert {i: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for i, r in got.items()} == contaminated(docs)


def whole_pieces(rows, texts, ids_of):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    seqs = {}
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and ids_of(r) == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in seqs.values():
        end = 0
        for start, length in sorted(pieces):
            assert start == end
            end += length
        assert end <= 1024
    total = sum(sum(n for _, n in p) for p in seqs.values())
    return total / sum(1 << (sum(n for _, n in p) - 1).bit_length() if sum(n for _, n in p) & (sum(n for _, n in p) - 1) == 0 else 1024 for p in seqs.values())


def test_pieces(spark, docs):
    rows = llm.queries()["op9_packing"](spark, DIR).collect()
    assert whole_pieces(rows, docs, lambda r: r["ids_crc32"]) > 0.9


def test_vectors(spark):
    df = pd.read_parquet(f"{DIR}/embeddings.parquet")
    column = next(c for c in df.columns if df[c].map(lambda v: isinstance(v, np.ndarray)).any())
    got = rows_of(spark, "op1_embeddings", "vec_id")
    assert set(got) == set(df["vec_id"])
    usable = {int(i): np.array(v, float) for i, v in zip(df["vec_id"], df[column]) if v is not None and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(v)}
    keys = sorted(usable)
    x = np.array([usable[k] / np.linalg.norm(usable[k]) for k in keys])
    near = x @ x.T
    assert not ((np.abs(near - 0.9) < 1e-9).any())
    link = near >= 0.9
    np.fill_diagonal(link, False)
    label = np.array(keys)
    while True:
        nxt = np.minimum(label, np.where(link, label[None], np.iinfo(np.int64).max).min(1))
        if np.array_equal(nxt, label):
            break
        label = nxt
    for k, n, c in zip(keys, link.sum(1), label):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (n, c, k == c)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = []
    for (name, stage), check in zip(corpus_pipeline.STAGES, ["quality", "near", "benchmark", "secrets", "packing"]):
        before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        after = stage(spark, docs, DIR).persist()
        kept = set(r["doc_id"] for r in after.select("doc_id").collect())
        if check != "packing":
            assert tuple(after.columns) == corpus_pipeline.COLUMNS and after.count() == len(kept)
        if check == "quality":
            scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))).collect()}
            assert kept == {i for i, s in scores.items() if s >= 0.3}
        elif check == "near":
            assert kept == {i for i, c in groups(before, 5, 80)[1].items() if i == c}
        elif check == "benchmark":
            assert kept == {i for i, v in contaminated(before).items() if not v[4]}
        elif check == "secrets":
            assert kept == set(before)
            for r in after.collect():
                want = before[r["doc_id"]]
                assert r["n_chars"] == len(r["text"] or "") and (("[secret]" in (r["text"] or "")) or (r["text"] or "") == want)
                assert not [s for s in secret_scan.base_spans((r["text"] or "").replace("[secret]", "\n")) if s[2] in ("access", "hex")]
        else:
            assert whole_pieces(after.collect(), before, lambda r: zlib.crc32(bytes(r["ids"]))) > 0.9
        seen.append(name)
        docs = after
    assert seen == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    assert docs.select(F.countDistinct("doc_id")).first()[0] == len(before)


def test_pipeline_takes_odd_rows(spark, tmp_path):
    base = "the old mill by the river grinds corn for all the villages around it and the miller sings a long song about water. "
    texts = [None, "", " ", base, base, base + "And then it rains.", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" " + base * 3, "wort " * 20_000, "ü" * 300]
    docs = [(i, t, "en", None, None, 1, "x") for i, t in enumerate(texts)] + [(3, base, "en", None, None, 2, "y"), (None, base, None, None, None, 3, "z"), (None, None, None, None, None, 4, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rank int, findings string"
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20))), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, None), (4, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for name, rows, n in (("odd", docs, 9), ("none", [], 0)):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        whole = corpus_pipeline.run(spark, folder).collect()
        assert len(whole) >= 0 and (n or not whole)
        current = spark.read.parquet(f"{folder}/documents.parquet")
        for stage in (f for _, f in corpus_pipeline.STAGES[1:4]):  # what the classifier keeps of nine rows is no matter here
            current = stage(spark, current, folder)
            assert tuple(current.columns) == corpus_pipeline.COLUMNS
        kept = {}
        for r in current.collect():
            kept.setdefault(r["doc_id"], []).append(r["text"])
        if not rows:
            assert not kept
            continue
        assert {i: len(v) for i, v in kept.items()} == {0: 1, 1: 1, 2: 1, 3: 1, 6: 1, 7: 1, 8: 1, None: 2}
        assert kept[0] == [None] and kept[1] == [""] and "[secret]" in kept[6][0] and kept[3] == [base] and kept[7] == ["wort " * 20_000]


def test_shards_one_by_one(spark, docs):
    """The ring and its overflow, key by key, against the query."""
    n, shards, vnodes = len(docs), 40, 128
    ends = sorted((int(hashlib.md5(f"{s}:{v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(vnodes))
    free = [n // shards + (s < n % shards) for s in range(shards)]
    waiting = {}
    for place, i in sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i) for i in docs):
        arc = next((k for k, (p, _) in enumerate(ends) if p >= place), 0)
        waiting.setdefault(arc, []).append(i)
    want, taken = {}, [0] * shards
    for step in range(len(ends)):
        for arc in sorted(waiting):
            s = ends[(arc + step) % len(ends)][1]
            while waiting[arc] and free[s]:
                want[waiting[arc].pop(0)] = (s, taken[s])
                taken[s] += 1
                free[s] -= 1
        waiting = {a: w for a, w in waiting.items() if w}
        if not waiting:
            break
    assert {i: (r["shard"], r["slot"]) for i, r in rows_of(spark, "op5_sharding").items()} == want
