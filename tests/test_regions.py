"""Neighbours by boxes: equal to all pairs, with far fewer met."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import clustering, regions
from millrace.operators.clustering import NearestNeighbors, distances


def _rows(seed=3, n=1500):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(0, 3, n), rng.integers(0, 12, n)]).astype(float)
    x[200:500] = x[:60].repeat(5, 0)  # copies
    x[600:900] = x[0]  # a hub
    x[1400:] = [400.0, -300.0]  # far from all others
    return x


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_boxes_find_what_all_pairs_do(spark, monkeypatch, metric):
    x = _rows()
    monkeypatch.setattr(regions, "QUERIES", 50)
    df = spark.createDataFrame([(i, float(a), float(b), i % 7) for i, (a, b) in enumerate(x)], "id long, a double, b double, label int")
    m = NearestNeighbors(["a", "b"], k=5, block=64, distance_metric=metric).fit(df.where("id % 10 <> 0"))
    seen, real = [], clustering._met
    monkeypatch.setattr(clustering, "_met", lambda q, *rest: seen.append(q.count()) or real(q, *rest))
    got = {}
    for r in m.neighbors(df).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["tid"], r["tlabel"], r["distance"]))
    train = np.array([i for i in range(len(x)) if i % 10])
    d = distances(x, x[train], metric)
    for i in range(len(x)):
        order = np.lexsort((train, d[i]))[:5]
        assert sorted(got[i]) == [(r + 1, train[j], train[j] % 7, d[i, j]) for r, j in enumerate(order)]
    # All pairs of blocks would send every row to 22 blocks.
    assert seen[0] == len(x) and sum(seen) < 11 * len(x)


def test_a_query_without_a_feature_has_no_neighbours(spark):
    df = spark.createDataFrame([(i, float(i % 37), 0) for i in range(200)], "id long, a double, label int")
    q = spark.createDataFrame([(1, 3.0), (2, None), (3, float("nan"))], "id long, a double")
    m = NearestNeighbors(["a"], k=2, block=16).fit(df)
    assert sorted((r["id"], r["tid"]) for r in m.neighbors(q).collect()) == [(1, 3), (1, 40)]
    assert m.neighbors(q.where(F.lit(False))).count() == 0
