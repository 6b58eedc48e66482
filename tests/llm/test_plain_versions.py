"""Parts of earlier operators against plain loops: the byte network's scores, decontamination with several automata."""

import math

import numpy as np

from millrace.llm import decontaminate
from millrace.llm.byte_cnn import ByteCnn


def plain_probability(net, text):
    """Window by window, filter by filter."""
    width, n = len(net.filters), net.filters.shape[2]
    room = len(text) + width
    room += -room % net.stride
    windows = []
    for w in range(room // net.stride - (width - 1) // net.stride):
        own = [0.0] * n
        for k in range(width):
            at = w * net.stride + k
            if at < len(text) and text[at]:
                own = [a + float(b) for a, b in zip(own, net.filters[k][text[at]])]
        windows.append(own)
    chunks = [windows[k : k + net.chunk] for k in range(0, len(windows), net.chunk)]
    act = [[max(max(x[f] for x in c) + float(net.bias[f]), 0.0) for f in range(n)] for c in chunks]
    z = net.out_bias + sum(float(net.out[f]) * max(a[f] for a in act) + float(net.out[n + f]) * sum(a[f] for a in act) / len(act) for f in range(n))
    return 1 / (1 + math.exp(-z))


def test_network_against_plain_loops():
    rng = np.random.default_rng(2)
    net = ByteCnn.new(n_filters=5, chunk=16, seed=3)
    net.bias[:] = rng.normal(size=5)
    net.out_bias = 0.3
    texts = [b"", b"a", b"\x00\x00ab\x00", bytes(rng.integers(0, 256, 31).tolist()), bytes(rng.integers(0, 256, 32).tolist()), bytes(rng.integers(32, 127, 700).tolist()), "Übergrößenträger 日本".encode(), b"x" * 33]
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    got = net.probability(np.frombuffer(b"".join(texts), np.uint8), starts, ends)
    assert np.allclose(got, [plain_probability(net, t) for t in texts], atol=1e-5)
    net.fit([b"good text", b"bad!!", b"fine words", b"###"], np.array([1, 0, 1, 0]), epochs=2)
    got = net.probability(np.frombuffer(b"".join(texts), np.uint8), starts, ends)
    assert np.allclose(got, [plain_probability(net, t) for t in texts], atol=1e-5)


def test_many_automata_find_what_one_finds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(k, text(int(rng.integers(1, 25)))) for k in range(40)] + [(7, None), (None, text(14)), (41, "")]
    docs = [(k, " . ".join([text(int(rng.integers(0, 30))), (items[k % 40][1] or "").upper(), text(5)])) for k in range(60)] + [(99, None), (98, "")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for chars in (decontaminate.AUTOMATON_CHARS, 3000):
        monkeypatch.setattr(decontaminate, "AUTOMATON_CHARS", chars)
        found.append(sorted(map(str, decontaminate.scan(a, b).collect())))
    assert found[0] == found[1] and any("contaminated=True" in r for r in found[0])
