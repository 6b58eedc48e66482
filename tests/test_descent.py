"""Neighbour graphs by descent against all pairs."""

import glob

import numpy as np
import pytest

from millrace.operators.descent import neighbour_descent
from millrace.operators.embedding import Umap, block_neighbours


def frame(spark, x):
    return spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "i long, x array<double>").repartition(3)


def exact(x, k, metric="euclidean"):
    d = np.abs(x[:, None] - x[None]).sum(2) if metric == "manhattan" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return {i: set(np.argsort(row, kind="stable")[:k].tolist()) for i, row in enumerate(d)}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_recall(spark, metric):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 6)) + 4 * c for c in range(4)])
    count = lambda: len(glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file:')}/loop/*"))
    df, before = frame(spark, x), count()
    found = neighbour_descent(df, 10, metric)
    rows = found.collect()
    got = {}
    for r in rows:
        got.setdefault(r["i"], set()).add(r["j"])
    want = exact(x, 10, metric)
    assert len(rows) == 12_000 and all(i not in own and len(own) == 10 for i, own in got.items())
    assert sum(len(got[i] & want[i]) for i in want) / 12_000 >= 0.9
    assert np.allclose([r["d"] for r in rows[:50]], [(np.abs(x[r["i"]] - x[r["j"]]).sum() if metric == "manhattan" else np.linalg.norm(x[r["i"]] - x[r["j"]])) for r in rows[:50]])
    assert count() <= before + 2  # the lists, and the row numbers' own table


def test_few_rows_and_ways(spark):
    x = np.random.default_rng(1).normal(size=(5, 2))
    assert {r["i"] for r in neighbour_descent(frame(spark, x), 10).collect()} == set(range(5))
    assert neighbour_descent(frame(spark, x), 10).count() == 20
    assert neighbour_descent(frame(spark, x[:1]), 3).count() == 0
    df = frame(spark, np.random.default_rng(2).normal(size=(200, 3)))
    pairs, blocks = (sorted((r["i"], r["j"], round(r["d"], 9)) for r in way.select("i", "j", "d").collect()) for way in (Umap(["a"], n_neighbors=7).nearest(df), block_neighbours(df, 7, "euclidean")))
    assert pairs == blocks


def test_layouts_without_all_pairs(spark):
    x = np.concatenate([np.random.default_rng(4).normal(size=(60, 3)), np.random.default_rng(5).normal(size=(60, 3)) + 9])
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(x.tolist())], "id long, a double, b double, c double")
    for way in ("blocks", "descent"):
        y = Umap(["a", "b", "c"], n_neighbors=8, n_epochs=3, neighbours=way, max_rows=10).fit_transform(df).toPandas().sort_values("id")[["y_0", "y_1"]].to_numpy()
        near = lambda own, other: np.linalg.norm(own[:, None] - other[None], axis=2).mean()
        assert near(y[:60], y[:60]) < near(y[:60], y[60:])
    with pytest.raises(ValueError, match="unknown way"):
        Umap(["a"], neighbours="x").nearest(df)
