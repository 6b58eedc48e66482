"""Agglomerative clustering of more different points than a matrix is kept of."""

import numpy as np
import pytest

from millrace.operators import merging
from millrace.operators.clustering import Agglomerative


@pytest.mark.parametrize("linkage, metric", [("average", "euclidean"), ("ward", "euclidean"), ("complete", "manhattan"), ("single", "euclidean"), ("average", "cosine"), ("ward", "manhattan")])
def test_more_points_than_pairs_are_kept_of(spark, monkeypatch, linkage, metric):
    monkeypatch.setattr(merging, "OWN", 16)
    monkeypatch.setattr(merging, "HELD", 64)  # large clusters are met in parts
    rng = np.random.default_rng(5)
    x = np.concatenate([np.stack([rng.uniform(-1, 10, 60), rng.integers(0, 4, 60)], 1), rng.normal(size=(30, 2)) * 0.1 + 30])
    x = x.repeat(np.where(np.arange(len(x)) % 7, 1, 3), 0)  # equal points
    df = spark.createDataFrame([(i * 2, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    whole, parts = (Agglomerative(["a", "b"], 5, linkage, metric, max_rows=n).fit(df) for n in (200, 20))
    assert [(r[0], r[1], r[3]) for r in whole.merges] == [(r[0], r[1], r[3]) for r in parts.merges]
    assert np.allclose([r[2] for r in whole.merges], [r[2] for r in parts.merges], rtol=1e-9, atol=1e-9)
    assert whole.labels == parts.labels and len(set(whole.labels.values())) == 5


def test_heights_are_mean_distances(spark):
    x = np.random.default_rng(3).normal(size=(40, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    m = Agglomerative(["a", "b"], 3, max_rows=6).fit(df)
    own, want = [[i] for i in range(40)], []
    while len(own) > 1:
        d, a, b = min((np.sqrt(((x[own[a]][:, None] - x[own[b]][None]) ** 2).sum(2)).mean(), a, b) for a in range(len(own)) for b in range(a + 1, len(own)))
        want.append(d)
        own[a] += own.pop(b)
    assert np.allclose([r[2] for r in m.merges], want)
    assert abs(m.cophenetic_correlation(df) - Agglomerative(["a", "b"], 3).fit(df).cophenetic_correlation(df)) < 1e-9


def test_distances_without_end(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 1.0, float("inf"), float("-inf"), 5.0, 6.5])], "id long, a double")
    for n in (5000, 2):
        m = Agglomerative(["a"], 3, "single", max_rows=n).fit(df)
        assert [r[2] for r in m.merges[:3]] == [1.0, 1.5, 4.0] and m.labels == {0: 0, 1: 0, 4: 0, 5: 0, 2: 1, 3: 2}
    assert Agglomerative(["a"]).fit_predict(df.limit(0)).count() == 0
