"""Secret scan: fixed patterns, and a character convolutional network over every run of token characters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import sampled, string_buffer, table, text_chunks

KINDS = ("assign", "access", "hex")
#: Kind of the spans that the network adds.
OTHER = "other"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
#: Candidates are all whole runs of these bytes, of any length.
_RUN = np.zeros(256, bool)
_RUN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-", np.uint8)] = True
#: Runs, and what is between them, on either side of a candidate that the network sees as its context.
CONTEXT = 4
#: Share of the labelled secrets set aside for calibration that the threshold must catch.
RECALL = 0.98
#: Documents that plain runs are learned from, at most: those least by a hash of the id.
FIT_ROWS = 200
#: Bytes of a convolution.
BLOCK_BYTES = 1 << 18
#: Text bytes that are scanned at once (a longer text is scanned alone): every byte takes some 150 of memory, by its segments.
SCAN_BYTES = 512 << 10


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed: leftmost non-overlapping matches of each kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def labelled_findings(rows: int = 6000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """A small labelled table: text before, candidate, text after, 1 for a secret.

    Secrets are keys of usual forms, random passwords and passphrases after words that announce one; the others are
    digests, ids, paths, versions, addresses, numbers, long names and plain words in the contexts they have in
    prose, logs and code, also after such words.
    """
    rng = np.random.default_rng(seed)
    hexa, base64, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    lower, letters = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    draw = lambda chars, n: "".join(rng.choice(list(chars), n))
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es", "in", "ou", "al", "ent", "sch", "ció", "eau", "St", "and"], rng.integers(1, 5)))
    plain = lambda: word().replace("ó", "o").lower()
    prose = lambda: " ".join(word() for _ in range(rng.integers(2, 6)))
    one = lambda *xs: str(xs[rng.integers(len(xs))])
    leads = ["key ", "client_key=", "credential: ", "Authorization: Bearer ", "auth = ", "access key ", "private_key: ", "secret ", "pwd=", "token ", "signing key: ", "pwd: ", "credentials "]
    out = []
    for i in range(rows):
        before, after = prose(), prose()
        if i % 3 == 0:
            strong = one(draw(base64, 40), "ghp_" + draw(alnum, 36), "xoxb-" + draw("0123456789", 12) + "-" + draw(alnum, 24), "sk_live_" + draw(alnum, 24), "eyJ" + draw(base64, 30) + "." + draw(base64, 40), draw(alnum, 32), draw(base64, 44) + "==", "AIza" + draw(alnum, 35), draw(alnum, 20), draw(letters, 24), draw(base64, 64))
            weak = one(draw(alnum, 10), draw(alnum, 12), draw(letters, 14), draw(lower + "0123456789", 12), draw("0123456789", 4) + draw(lower, 6) + draw("0123456789", 2))
            value, lead = (weak, one(*leads)) if rng.random() < 0.35 else (strong, one(*leads, "see ", "file ", "", "with ", "from "))
            out.append((f"{before} {lead}", value, f" {after}", 1))
        else:
            value = one("-".join(draw(hexa, n) for n in (8, 4, 4, 4, 12)), "/usr/lib/" + plain() + "/" + plain() + str(rng.integers(99)), "mail" + str(rng.integers(99)) + ".example.com", plain() + "." + plain() + str(rng.integers(99)) + ".example.net", plain() + "_" + plain() + "_" + str(rng.integers(2000, 2030)) + "_final", draw("0123456789", rng.integers(1, 20)), "v1.2." + str(rng.integers(99)) + "-" + plain(), draw("ACGT", 30) + "5", plain() + plain() + plain() + "2" + plain(), plain() + str(rng.integers(99)) + ".png", "=" * int(rng.integers(3, 40)), "-" * int(rng.integers(3, 40)), ".".join(draw("0123456789", 3) for _ in range(4)), plain(), plain() + plain() + plain() + plain(), plain().upper(), plain().title() + plain().title() + plain().title(), "2024-0" + draw("123456789", 1) + "-1" + draw("0123456789", 1), "555-" + draw("0123456789", 4), plain() + "." + draw("0123456789", 2))
            lead = one("see ", "file ", "commit ", "id ", "version ", "sample ", "", "page ", "from ", "build ", "request ", one(*leads) if value.isalpha() and len(value) < 12 else "at ")
            out.append((f"{before} {lead}", value, f" {after}", 0))
    return out


@dataclass
class Texts:
    """Texts on end, each with zeros after it; their segments: candidates and what is between them."""

    data: np.ndarray
    first: np.ndarray  # first byte of each segment
    text: np.ndarray  # its text
    run: np.ndarray  # whether it is a candidate
    base: np.ndarray  # first byte of each text

    @staticmethod
    def of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> Texts:
        sizes = ends - starts
        base = np.concatenate([[0], np.cumsum(sizes + width)])
        out = np.zeros(base[-1], np.uint8)
        out[np.arange(len(data)) + np.repeat(base[:-1] - starts, sizes)] = data
        run = _RUN[out]
        begins = np.append(True, run[1:] != run[:-1]) if len(out) else np.zeros(0, bool)
        begins[base[:-1]] = True
        first = np.flatnonzero(begins)
        return Texts(out, first, np.searchsorted(base, first, side="right") - 1, run[first], base[:-1])

    def stop(self) -> np.ndarray:
        return np.append(self.first[1:], len(self.data))


@dataclass
class SpanCnn:
    """Filters over characters, pooled over a candidate (maximum and mean) and over the segments around it (maximum),
    with the logarithm of its length; one logit.  Arrays have a row for each filter."""

    filters: np.ndarray  # width x F x 256
    bias: np.ndarray
    out: np.ndarray  # 4F + 1: own maximum, own mean, before, after, length
    out_bias: np.ndarray

    @staticmethod
    def new(width: int = 5, n_filters: int = 8, seed: int = 3) -> SpanCnn:
        rng = np.random.default_rng(seed)
        filters = rng.normal(0, 0.3, (width, n_filters, 256)).astype(np.float32)
        filters[:, :, 0] = 0  # between texts
        return SpanCnn(filters, np.zeros(n_filters, np.float32), rng.normal(0, 0.1, 4 * n_filters + 1).astype(np.float32), np.zeros(1, np.float32))

    def conv(self, data: np.ndarray) -> np.ndarray:
        """Filters at every byte, with their bias; what is beyond the end counts as zero."""
        at = np.append(data, np.zeros(len(self.filters) - 1, np.uint8)).astype(np.intp)
        total = np.repeat(self.bias[:, None], len(data), 1)
        for k, taps in enumerate(self.filters):
            for row, tap in zip(total, taps):
                row += tap.take(at[k : k + len(data)])
        return total

    def pooled(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Maximum and mean over each segment, negative values as zero; block by block, so memory is bounded by segments."""
        n, n_f, width = len(t.first), len(self.bias), len(self.filters)
        most, total = np.zeros((n_f, n), np.float32), np.zeros((n_f, n), np.float32)
        for lo in range(0, len(t.data), BLOCK_BYTES):
            hi = min(len(t.data), lo + BLOCK_BYTES)
            c = self.conv(t.data[lo : hi + width - 1])[:, : hi - lo]
            np.maximum(c, 0, out=c)
            a, b = np.searchsorted(t.first, lo, side="right") - 1, np.searchsorted(t.first, hi)
            at = np.maximum(t.first[a:b] - lo, 0)
            for k in range(n_f):
                most[k, a:b] = np.maximum(most[k, a:b], np.maximum.reduceat(c[k], at))
                total[k, a:b] += np.add.reduceat(c[k], at)
        return most, total / np.maximum(1, t.stop() - t.first)

    @staticmethod
    def around(t: Texts, most: np.ndarray, side: int) -> np.ndarray:
        """Maximum over the CONTEXT segments of the same text on one side of each."""
        n, best = most.shape[1], np.zeros_like(most)
        for k in range(1, min(CONTEXT, n - 1) + 1):
            same = t.text[k:] == t.text[:-k]
            to, of = (best[:, k:], most[:, :-k]) if side < 0 else (best[:, :-k], most[:, k:])
            np.maximum(to, of * same, out=to)
        return best

    def features(self, t: Texts, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most, mean = self.pooled(t)
        length = np.log1p((t.stop() - t.first)[pick])[None].astype(np.float32)
        parts = (most, mean, self.around(t, most, -1), self.around(t, most, 1))
        return np.concatenate([*(p.take(pick, 1) for p in parts), length]), most

    def logits(self, t: Texts, pick: np.ndarray) -> np.ndarray:
        return (self.out @ self.features(t, pick)[0] + self.out_bias).astype(np.float64)

    def fit(self, texts: list[bytes], labels: list[np.ndarray], epochs: int = 6, batch: int = 48, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> SpanCnn:
        """Adam on the log loss of every candidate, secrets weighted five-fold; labels are those of a text's candidates."""
        rng, n_f, width = np.random.default_rng(seed), len(self.bias), len(self.filters)
        weights = [self.filters, self.bias, self.out, self.out_bias]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                ends = np.cumsum([len(texts[i]) for i in own])
                t = Texts.of(np.frombuffer(b"".join(texts[i] for i in own), np.uint8), np.concatenate([[0], ends[:-1]]), ends, width)
                pick, y = np.flatnonzero(t.run), np.concatenate([labels[i] for i in own])
                if not len(pick):
                    continue
                x, most = self.features(t, pick)
                w = np.where(y == 1, 5.0, 1.0)
                g = ((1 / (1 + np.exp(-np.clip(self.out @ x + self.out_bias, -30, 30))) - y) * w / w.sum()).astype(np.float32)
                back = np.zeros((4 * n_f, len(t.first)), np.float32)
                back[:, pick] = self.out[: 4 * n_f, None] * g
                # The gradient of a maximum goes to the place that gave it, that of a mean to all places above zero.
                g_most = back[:n_f]
                for side, best, part in ((-1, self.around(t, most, -1), back[2 * n_f : 3 * n_f]), (1, self.around(t, most, 1), back[3 * n_f :])):
                    for k in range(1, min(CONTEXT, len(t.first) - 1) + 1):
                        same = t.text[k:] == t.text[:-k]
                        if side < 0:
                            g_most[:, :-k] += np.where(same & (most[:, :-k] == best[:, k:]), part[:, k:], 0)
                        else:
                            g_most[:, k:] += np.where(same & (most[:, k:] == best[:, :-k]), part[:, :-k], 0)
                size = t.stop() - t.first
                seg = np.repeat(np.arange(len(size)), size)
                c = self.conv(t.data)
                g_conv = np.where(c > 0, (c == most[:, seg]) * g_most[:, seg] + (back[n_f : 2 * n_f] / size)[:, seg], 0)
                padded = np.append(t.data, np.zeros(width - 1, np.uint8))
                g_filters = np.stack([[np.bincount(padded[k : k + len(t.data)], weights=row, minlength=256) for row in g_conv] for k in range(width)]).astype(np.float32)
                g_filters[:, :, 0] = 0
                step += 1
                for w_, (m, v), grad in zip(weights, moments, (g_filters, g_conv.sum(1), x @ g, g.sum(keepdims=True))):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    w_ -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * w_)
        return self


@dataclass
class Scanner:
    net: SpanCnn
    slope: float
    shift: float
    threshold: float
    figures: dict = field(default_factory=dict)

    def candidates(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, first byte in it, end byte, probability) of every candidate of all texts."""
        t = Texts.of(data, starts, ends, len(self.net.filters))
        pick = np.flatnonzero(t.run)
        p = 1 / (1 + np.exp(-np.clip(self.slope * self.net.logits(t, pick) + self.shift, -60, 60)))
        begin = t.first[pick] - t.base[t.text[pick]]
        return t.text[pick], begin, begin + (t.stop() - t.first)[pick], p


def _runs(text: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(rb"[A-Za-z0-9+/_=.-]+", text)]


def labelled_texts(findings: list[tuple[str, str, str, int]]) -> tuple[list[bytes], list[np.ndarray]]:
    """Texts of findings, and 1 for the candidates that hold a secret."""
    texts, labels = [], []
    for before, value, after, secret in findings:
        raw, at = (before + value + after).encode(), len(before.encode())
        texts.append(raw)
        labels.append(np.array([int(secret and s <= at and at + len(value) <= e) for s, e in _runs(raw)]))
    return texts, labels


def labelled_documents(texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
    """Lines of documents: candidates in a match of a fixed pattern are secrets, those apart from all are plain."""
    out, labels = [], []
    for text in texts:
        for line in text.split("\n"):
            raw, found = line.encode(), base_spans(line)
            if not raw:
                continue
            at = spans.merged([(len(line[:s].encode()), len(line[:e].encode())) for s, e, _ in found])
            words = ("password", "passwd", "secret", "token", "api_key", "apikey")
            labels.append(np.array([int(not spans.apart(at, s, e) and raw[s:e].decode().lower() not in words) for s, e in _runs(raw)]))
            out.append(raw)
    return out, labels


def fit(findings: list[tuple[str, str, str, int]] | None = None, documents: list[str] | None = None, recall: float = RECALL) -> Scanner:
    """The network from two thirds of the labelled findings and of the lines of documents; the rest calibrates it (logistic
    on the logit) and sets the largest threshold that keeps `recall` of its secrets.  figures: what it is held to there."""
    texts, labels = labelled_texts(labelled_findings() if findings is None else findings)
    more, known = labelled_documents(documents or [])
    texts, labels = texts + more, labels + known
    held = np.arange(len(texts)) % 7 % 3 == 2  # not in step with the kinds of findings
    net = SpanCnn.new().fit([t for t, h in zip(texts, held) if not h], [y for y, h in zip(labels, held) if not h])
    own = [t for t, h in zip(texts, held) if h]
    ends = np.cumsum([len(t) for t in own])
    t = Texts.of(np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], ends[:-1]]), ends, len(net.filters))
    z, y = net.logits(t, np.flatnonzero(t.run)), np.concatenate([y for y, h in zip(labels, held) if h])
    slope, shift = 1.0, 0.0
    for _ in range(30):  # Newton steps, with a little ridge
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -60, 60)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * z).sum() + 0.1 * (slope - 1), (p - y).sum()])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        slope, shift = np.array([slope, shift]) - np.linalg.solve(h, g)
    p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -60, 60)))
    secrets = np.sort(p[y == 1])
    threshold = float(secrets[int((1 - recall) * len(secrets))]) if len(secrets) else np.inf
    figures = {"secrets": len(secrets), "recall": float((secrets >= threshold).mean()) if len(secrets) else 0.0, "plain": int((y == 0).sum()), "false": int((p[y == 0] >= threshold).sum())}
    return Scanner(net, float(slope), float(shift), threshold, figures)


def sample(docs: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> list[str]:
    """At most `rows` texts to learn from: those least by a hash of key and text."""
    own = docs.where(F.length(text) > 0).select(key, text)
    return [r[text] for r in sampled(own, rows, docs.count(), key, text).collect()]


def scan(docs: DataFrame, scanner: Scanner, text: str = "text") -> DataFrame:
    """docs with findings: matches of the fixed patterns (base), and the candidates not within them that
    the network scores at its threshold or above; by start, then kind (assign, access, hex, other).

    The whole text is scanned and every candidate scored; a null or empty one has no findings.  A column named findings
    is replaced, all others stay; an empty table stays empty, repeated rows get the same findings.
    """
    docs = docs.drop("findings")
    columns, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_chunks(batches, text, SCAN_BYTES):
            data, ends, starts = string_buffer(batch.column(text))
            raw = data.tobytes()
            rows = []
            for s, e in zip(starts.tolist(), ends.tolist()):
                rows.append([{"kind": k, "start": a, "end": b, "score": 1.0, "base": True} for a, b, k in base_spans(raw[s:e].decode())])
            which, begin, end, p = own.candidates(data, starts, ends)
            for at in np.flatnonzero(p >= own.threshold).tolist():
                i = int(which[at])
                s = int(starts[i])
                a = len(raw[s : s + int(begin[at])].decode())
                b = a + int(end[at] - begin[at])  # candidates are ASCII
                if not any(x <= a and b <= y for x, y in spans.merged([(r["start"], r["end"]) for r in rows[i] if r["base"]])):
                    rows[i].append({"kind": OTHER, "start": a, "end": b, "score": float(p[at]), "base": False})
            order = {k: i for i, k in enumerate((*KINDS, OTHER))}
            for r in rows:
                r.sort(key=lambda x: (x["start"], order[x["kind"]]))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
            yield pa.record_batch([*batch.columns, pa.array(rows, kind)], names=[*columns, "findings"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{ddl}, findings {spans.SPAN_DDL}")


def redact(found: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The result of scan() with every finding in the text replaced by mask (overlapping ones by one).

    A null text stays null; all columns stay.
    """
    runs = (
        "aggregate(findings, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, f) -> "
        "if(size(acc) > 0 and f.start <= element_at(acc, -1).end, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, f.end)))), "
        "concat(acc, array(named_struct('start', f.start, 'end', f.end)))))"
    )
    # One more run after the last, past the end of the text, carries the rest of it.
    pieces = (
        f"transform(array({runs}), runs -> concat(array_join(transform(runs, (r, i) -> concat(substring(`{text}`, cast(if(i = 0, 0, runs[i - 1].end) as int) + 1, "
        f"cast(r.start - if(i = 0, 0, runs[i - 1].end) as int)), '{mask}')), ''), substring(`{text}`, cast(element_at(runs, -1).end as int) + 1)))[0]"
    )
    return found.withColumn(text, F.when(F.size("findings") > 0, F.expr(pieces)).otherwise(F.col(text)))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(documents=sample(docs)))
    f = F.col("findings")
    return found.select("doc_id", *[spans.count(f, k).alias(f"n_{k}") for k in KINDS], spans.digest(f).alias("base_sha256"), spans.listed(f).alias("spans"))


QUERIES = {"op4_secrets": op4_secrets}
ORACLE: dict[str, str] = {}
