"""Factorization's passes over packed ratings, and products beyond the limit."""

import numpy as np
import pandas as pd
import pytest

from millrace.operators import embedding, factors
from millrace.operators.embedding import MatrixFactorization


@pytest.fixture(scope="module")
def ratings(spark):
    rng = np.random.default_rng(3)
    rows = [(int(u), f"i{i:02d}", float(rng.integers(1, 6))) for u in range(50) for i in range(30) if rng.random() < 0.3]
    rows += [(7, f"i{i:02d}", 5.0) for i in range(30)] * 2 + [(None, "i01", 3.0), (3, None, 3.0), (4, "i02", None)]
    return spark.createDataFrame(rows, "user long, item string, rating double").repartition(3)


def test_an_epoch_reads_the_ratings_once(spark, ratings, monkeypatch):
    calls, whole = [], embedding.rating_sums
    monkeypatch.setattr(embedding, "rating_sums", lambda *a: calls.append(a) or whole(*a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # a user's ratings in several rows
    edges = spark.createDataFrame([(1, 2), (5, 7)], "user long, friend long")
    make = lambda: MatrixFactorization(3, n_epochs=4, learning_rate=0.05, init_std=1.0, decay=0.9, social=0.5).fit(ratings, edges)
    one = make()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(calls) == 4
    monkeypatch.setattr(embedding, "BROADCAST_BYTES", 0)
    two = make()
    assert len(calls) == 4 and np.allclose(one.losses, two.losses)
    for side in ("users", "items"):
        a, b = ({r[0]: [r[1], *r[2]] for r in getattr(m, side).collect()} for m in (one, two))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a) and getattr(one, side).dtypes == getattr(two, side).dtypes


@pytest.mark.parametrize("limits", [(1.0, 5.0), (None, None), (2.4, 2.6)])
def test_few_products_are_worked_out(monkeypatch, limits):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 3)) * 0.1, np.full((300, 1), 2.5), np.ones((300, 1))], 1)
    y = np.concatenate([rng.normal(size=(4000, 3)) * 0.1, np.ones((4000, 1)), rng.normal(size=(4000, 1)) * 6], 1)  # a third beyond 5
    given = [rng.integers(0, 4000, 30) for _ in range(300)]
    rows = [{"kind": 0, "user": u, "item": None, "x": list(x[u]), "given": None} for u in range(300)] + [{"kind": 1, "user": None, "item": i, "x": list(y[i]), "given": None} for i in range(4000)]
    rows += [{"kind": 2, "user": u, "item": None, "x": None, "given": given[u]} for u in range(300)]
    frame = pd.DataFrame(rows)
    frame["item"] = frame["item"].fillna(0).astype(int)
    met, whole = [], factors._first
    monkeypatch.setattr(factors, "_first", lambda s, c, k: met.append(s.size) or whole(s, c, k))
    got = factors._products(3, *limits)(frame).sort_values(["user", "prediction", "item"], ascending=[True, False, True])
    s = sum(x[:, f, None] * y[:, f] for f in range(5))
    s = s if limits[0] is None else np.clip(s, *limits)
    for u in range(300):
        s[u, given[u]] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(4000), s.shape), -s), axis=1)[:, :3]
    assert got["item"].tolist() == order.ravel().tolist() and got["prediction"].tolist() == np.take_along_axis(s, order, 1).ravel().tolist()
    assert sum(met) < 0.1 * s.size
