"""Operators on all pairs without a table of pairs."""

import numpy as np

from millrace.functions import metrics
from millrace.operators.clustering import Agglomerative
from millrace.operators.embedding import Tsne, Umap


def test_silhouette_keeps_no_pairs(spark):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(90, 2)), rng.integers(0, 4, 90)
    c[5] = 9  # alone in its cluster
    df = spark.createDataFrame([(i, int(k), float(a), float(b)) for i, (k, (a, b)) in enumerate(zip(c, x))] + [(100, 1, None, 2.0), (101, None, 1.0, 2.0)], "id long, c int, a double, b double")
    found = metrics.pairwise_silhouette(df, ["a", "b"], "c", "id", block=20)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = {r["id"]: r["silhouette"] for r in found.collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(90):
        mean = {k: d[i][(c == k) & (np.arange(90) != i)].mean() for k in set(c) if ((c == k) & (np.arange(90) != i)).any()}
        a, b = mean.pop(c[i], None), None
        b = min(v for k, v in mean.items() if k != c[i])
        assert abs(got[i] - (0 if a is None else (b - a) / max(a, b))) < 1e-12
    assert got[100] == got[101] == 0 and len(got) == 92


def test_layout_of_more_rows_than_pairs_are_kept_of(spark):
    x = np.random.default_rng(4).normal(size=(60, 2))
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(x.tolist())], "id long, a double, b double")
    few, many = (Umap(["a", "b"], n_neighbors=8, n_epochs=2, max_rows=n).fit_transform(df).toPandas().sort_values("id")[["y_0", "y_1"]].to_numpy() for n in (10, 20000))
    assert np.allclose(few, many)


def test_tsne_of_more_rows_than_pairs_are_kept_of(spark):
    x = np.random.default_rng(4).normal(size=(50, 2))
    x[20:30] = x[0]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(x.tolist())], "id long, a double, b double")
    models = [Tsne(["a", "b"], perplexity=6, n_iter=2, max_rows=n) for n in (10, 5000)]
    few, many = (m.fit_transform(df).toPandas().sort_values("id")[["y_0", "y_1"]].to_numpy() for m in models)
    assert np.allclose(few, many, rtol=1e-9, atol=1e-12)
    assert abs(models[0].divergence - models[1].divergence) < 1e-9


def test_equal_points_are_no_pairs(spark):
    x = np.random.default_rng(7).normal(size=(12, 2)).repeat([1, 4, 1, 1, 3, 1, 1, 1, 2, 1, 1, 1], 0)
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(x.tolist())], "id long, a double, b double")
    for linkage in ("average", "ward"):
        m = Agglomerative(["a", "b"], 3, linkage, max_rows=12).fit(df)
        own, heights = [[i] for i in range(len(x))], []
        apart = {
            "average": lambda a, b: np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(2)).mean(),
            "ward": lambda a, b: np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0)),
        }[linkage]
        while len(own) > 1:
            d, a, b = min((apart(own[a], own[b]), a, b) for a in range(len(own)) for b in range(a + 1, len(own)))
            heights.append(d)
            own[a] += own.pop(b)
            if len(own) == 3:
                want = {i: k for k, c in enumerate(sorted(own, key=min)) for i in c}
        assert np.allclose([s[2] for s in m.merges], heights, atol=1e-7) and m.labels == want
