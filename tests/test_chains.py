"""Hidden Markov models over rows against those over arrays."""

import glob

import numpy as np
import pytest

from millrace.operators.chains import LongChains
from millrace.operators.sequences import HiddenMarkov


def model():
    return HiddenMarkov(["a", "b", "c"], ["x", "y"], [0.5, 0.3, 0.2], [[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.3, 0.3, 0.4]], [[0.9, 0.1], [0.2, 0.8], [0.5, 0.5]])


@pytest.fixture(scope="module")
def both(spark):
    """Rows and the same sequences as arrays: lengths around those of chunks, odd symbols."""
    rng = np.random.default_rng(3)
    lists = {k: rng.choice(["x", "y", "z"], n, p=[0.5, 0.45, 0.05]).tolist() for k, n in enumerate([1, 2, 7, 8, 9, 24, 25, 26, 71, 72, 73, 700])}
    lists[3][2] = None
    rows = spark.createDataFrame([(k, t, s) for k, own in lists.items() for t, s in enumerate(own)], "seq_id long, t long, symbol string").repartition(5)
    return rows, spark.createDataFrame([(k, ["?" if s is None else s for s in own]) for k, own in lists.items()], "seq_id long, symbols array<string>")


@pytest.mark.parametrize("chunk, fan", [(8, 3), (1024, 256)])
def test_rows_as_arrays(spark, both, chunk, fan):
    rows, arrays = both
    c = LongChains(model(), ["t"], chunk=chunk, fan=fan)
    got = {r["seq_id"]: (r["log_likelihood"], r["perplexity"]) for r in c.score(rows).collect()}
    want = {r["seq_id"]: (r["log_likelihood"], r["perplexity"]) for r in model().score(arrays).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], [want[k] for k in want])
    fitted, other = c.fit(rows, 3, 0).model, model().fit(arrays, 3, 0)
    for x in ("initial", "transition", "emission"):
        assert np.allclose(getattr(fitted, x), getattr(other, x))
    assert np.allclose(fitted.history, other.history) and fitted.history == sorted(fitted.history)


def test_one_long_sequence_and_what_it_leaves(spark):
    rng = np.random.default_rng(5)
    symbols = rng.choice(["x", "y"], 20_000).tolist()
    rows = spark.createDataFrame([(None, t, s) for t, s in enumerate(symbols)], "seq_id string, t long, symbol string").repartition(4)
    c = LongChains(model(), ["t"], chunk=64, fan=8)
    count = lambda: len(glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file:')}/loop/*"))
    before = count()
    chunks = c.chunks(rows)
    assert chunks.count() == 313 and max(len(r["codes"]) for r in chunks.collect()) == 64
    got = c.score(rows).collect()
    want = model().score(spark.createDataFrame([(0, symbols)], "seq_id long, symbols array<string>")).first()
    assert len(got) == 1 and np.isclose(got[0]["log_likelihood"], want["log_likelihood"])
    mid = count()
    c.fit(rows, 1)
    assert mid - before <= 8 and count() - mid <= 2  # the row numbers' own tables
    assert c.score(rows.limit(0)).count() == 0 and len(LongChains(model(), ["t"]).fit(rows.limit(0), 2).model.history) == 0


def test_anomalies(spark):
    rows = [(k, t, "x" if t % 10 else "y") for k in range(19) for t in range(30)] + [(99, t, "q") for t in range(30)]
    found = LongChains(model(), ["t"]).anomalies(spark.createDataFrame(rows, "seq_id long, t long, symbol string"), 0.05)
    assert {r["seq_id"] for r in found.where("is_anomaly").collect()} == {99}
