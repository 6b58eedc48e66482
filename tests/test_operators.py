import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import metrics
from millrace.functions.ordered import rotated, running
from millrace.operators.clustering import Agglomerative, GaussianMixture, KMeans, NearestNeighbors
from millrace.operators.embedding import IsolationForest, MatrixFactorization, Tsne, _start, path_correction
from millrace.operators.itemsets import Apriori
from millrace.operators.linear import AdditiveForecast, LeastSquares, PrincipalComponents
from millrace.operators.sequences import HiddenMarkov, TopicModel
from millrace.operators.trees import Boosting, DecisionTree, binned, cut_points, splits
from millrace.streaming.scoring import score_stream, windowed_mean


def rows(spark, data, names):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], ["id", *names])


def test_least_squares(spark):
    df = rows(spark, [(x, 25000 + 5000 * x) for x in range(1, 11)], ["x", "label"])
    m = LeastSquares(["x"]).fit(df)
    assert np.allclose([m.intercept, m.coefficients[0], m.score(df)], [25000, 5000, 1])
    assert LeastSquares(["x"], alpha=10).fit(df).coefficients[0] < 5000
    with pytest.raises(ValueError):
        LeastSquares(["x"]).fit(df.withColumn("x", F.lit(None).cast("double")))


def test_constant_label_has_no_r2(spark):
    df = rows(spark, [(1, 2), (2, 2)], ["prediction", "label"])
    assert metrics.r2(df) is None


def test_tree_root(spark):
    x = [(25, 30, 0), (45, 80, 1), (35, 50, 1), (20, 25, 0), (50, 90, 1), (30, 35, 0), (40, 70, 1), (22, 28, 0)]
    t = DecisionTree(["a", "b"]).fit(rows(spark, x, ["a", "b", "label"]))
    assert (t.tree[0]["feature"], t.tree[0]["threshold"], t.tree[0]["gain"]) == (0, 30, 0.5)
    assert (t.get_depth(), t.get_n_leaves()) == (2, 2)


def test_boosting_loss_falls(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-3, 3, 120)
    df = rows(spark, [(a, a * a) for a in x], ["x", "label"])
    for m in (Boosting(["x"], n_estimators=4, max_depth=2), Boosting.catboost(["x"], n_estimators=4, max_depth=2, max_bins=8, learning_rate=0.5)):
        m.fit(df, evaluation=df)
        assert all(b <= a + 1e-12 for a, b in zip(m.history, m.history[1:]))
        assert sum(m.get_feature_importance().values()) == pytest.approx(1)


def test_kmeans(spark):
    x = [(25, 30), (28, 35), (23, 28), (26, 32), (45, 80), (48, 85), (42, 78), (47, 82), (65, 50), (62, 55), (68, 52), (63, 48)]
    df = rows(spark, x, ["a", "b"])
    m = KMeans(["a", "b"], initial=[[25, 30], [45, 80], [65, 50]]).fit(df)
    assert m.inertia(df) == pytest.approx(135.25)
    g = GaussianMixture(["a", "b"], 3, max_iter=5, initial_means=m.centers.tolist()).fit(df)
    assert all(b >= a - 1e-6 for a, b in zip(g.history[1:], g.history[2:]))
    r = g.predict_proba(df).select(F.expr("p_0 + p_1 + p_2").alias("s")).collect()
    assert all(abs(x["s"] - 1) < 1e-9 for x in r)


def brute_tree(points, linkage, k):
    clusters = [[i] for i in range(len(points))]
    p = np.array(points, float)

    def d(a, b):
        m = np.sqrt(((p[a][:, None] - p[b][None]) ** 2).sum(2))
        if linkage == "ward":
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(p[a].mean(0) - p[b].mean(0))
        return {"single": m.min(), "complete": m.max(), "average": m.mean()}[linkage]

    while len(clusters) > k:
        i, j = min(((i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters))), key=lambda x: d(clusters[x[0]], clusters[x[1]]))
        clusters[i] += clusters.pop(j)
    return {frozenset(c) for c in clusters}


@pytest.mark.parametrize("linkage", ["single", "average", "ward"])
def test_agglomerative(spark, linkage):
    x = [(37.77, -122.42), (34.05, -118.24), (47.61, -122.33), (40.71, -74.01), (42.36, -71.06), (38.91, -77.04), (41.88, -87.63), (44.98, -93.27)]
    m = Agglomerative(["a", "b"], 3, linkage).fit(rows(spark, x, ["a", "b"]))
    found = {}
    for i, c in m.labels.items():
        found.setdefault(c, set()).add(i)
    assert {frozenset(c) for c in found.values()} == brute_tree(x, linkage, 3)


def test_neighbors(spark):
    x = [(150, 8, 0), (170, 9, 0), (140, 7, 0), (350, 4, 1), (380, 5, 1), (340, 3, 1), (200, 9, 2), (180, 10, 2), (190, 8, 2)]
    m = NearestNeighbors(["a", "b"], k=3).fit(rows(spark, x, ["a", "b", "label"]))
    q = rows(spark, [(160, 8), (360, 4), (185, 9)], ["a", "b"])
    assert [r["prediction"] for r in m.predict(q).orderBy("id").collect()] == [0, 1, 2]


def test_components(spark):
    df = rows(spark, [(2.5, 2.4, 3.1), (0.5, 0.7, 1.2), (2.2, 2.9, 2.7), (1.9, 2.2, 2.5), (3.1, 3.0, 3.3)], ["a", "b", "c"])
    m = PrincipalComponents(["a", "b", "c"]).fit(df)
    assert np.allclose(m.components @ m.components.T, np.eye(3))
    assert m.score(df) == pytest.approx(0, abs=1e-12)


def test_itemsets(spark):
    b = [["milk", "bread", "butter"], ["milk", "bread"], ["milk", "eggs"], ["bread", "butter"], ["milk", "bread", "butter", "eggs"], ["bread", "eggs"], ["milk", "butter"], ["milk", "bread", "eggs"], ["bread", "butter", "eggs"], ["milk", "bread"]]
    df = spark.createDataFrame([(i, x) for i, r in enumerate(b) for x in r], ["tid", "item"])
    m = Apriori(0.4, 0.7).fit(df)
    s = {tuple(r["items"]): round(r["support"], 6) for r in m.itemsets.collect()}
    assert s == {("bread",): 0.8, ("milk",): 0.7, ("butter",): 0.5, ("eggs",): 0.5, ("bread", "milk"): 0.5, ("bread", "butter"): 0.4, ("bread", "eggs"): 0.4}
    r = {(x["antecedent"][0], x["consequent"][0]): round(x["confidence"], 6) for x in m.generate_rules().collect()}
    assert r == {("milk", "bread"): 0.714286, ("butter", "bread"): 0.8, ("eggs", "bread"): 0.8}
    assert [x["item"] for x in m.predict(spark.createDataFrame([(1, "milk")], ["tid", "item"])).collect()] == ["bread"]


def test_hidden_markov(spark):
    m = HiddenMarkov(["Sunny", "Rainy"], ["Walk", "Shop", "Clean"], [0.6, 0.4], [[0.7, 0.3], [0.4, 0.6]], [[0.6, 0.3, 0.1], [0.1, 0.2, 0.7]])
    df = spark.createDataFrame([(1, ["Walk", "Shop", "Clean"]), (2, ["Walk", "Shop", "Clean", "Clean", "Walk"])], ["seq_id", "symbols"])
    ll = {r["seq_id"]: r["log_likelihood"] for r in m.score(df).collect()}
    assert np.exp(ll[1]) == pytest.approx(0.034656) and np.exp(ll[2]) == pytest.approx(0.0046596060)
    path = {r["seq_id"]: r for r in m.predict(df).collect()}
    assert path[2]["path"] == ["Sunny", "Sunny", "Rainy", "Rainy", "Sunny"] and np.exp(path[2]["log_probability"]) == pytest.approx(0.0016003008)


def test_ordered_target_statistic(spark):
    df = spark.createDataFrame([(i, "a", y) for i, y in enumerate([1, 0, 1, 1])], ["i", "c", "y"])
    got = [r["target_statistic"] for r in metrics.ordered_target_statistic(df, "c", "y", "i").orderBy("i").collect()]
    assert got == pytest.approx([0.5, 0.75, 0.5, 0.625])


def test_running_sums(spark):
    df = spark.range(200).select("id", ((F.col("id") * 37) % 101).alias("x"), F.lit(2.0).alias("v"))
    got = sorted(running(df, ["x", "id"], {"s": "v", "c": "1"}).collect(), key=lambda r: (r["x"], r["id"]))
    assert [r["s"] for r in got] == [2.0 * (k + 1) for k in range(200)] and [r["c"] for r in got] == list(range(1, 201))
    assert running(df.limit(0), ["x"], {"s": "v"}).count() == 0
    turned = {r["id"]: r["x"] for r in rotated(df, ["x", "id"], "x", 0.25).collect()}
    order = [r["id"] for r in got]
    assert all(turned[order[(k + 50) % 200]] == got[k]["x"] for k in range(200))


def test_best_first_leaves(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (300, 2))
    df = rows(spark, [(a, b, 10 * (a > 0.5) + (b > 0.3) * (a > 0.5) * 5 + 0.1 * (b > 0.8)) for a, b in x], ["a", "b", "label"])
    m = Boosting.lightgbm(["a", "b"], n_estimators=1, num_leaves=3, max_depth=8, min_samples_leaf=1).fit(df)
    assert sum("feature" not in n for n in m.trees[0].values()) == 3 and [m.features[n["feature"]] for n in splits(m.trees[0])] == ["a", "b"]
    full = Boosting.lightgbm(["a", "b"], n_estimators=1, num_leaves=64, max_depth=2, min_samples_leaf=1).fit(df)
    level = Boosting.lightgbm(["a", "b"], n_estimators=1, max_depth=2, min_samples_leaf=1).fit(df)
    assert {k: n.get("threshold") for k, n in full.trees[0].items()} == {k: n.get("threshold") for k, n in level.trees[0].items()}


def test_thresholds(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("few"), F.col("id").cast("double").alias("many"), F.lit(1.0).alias("one"))
    few, many, one = cut_points(df, ["few", "many", "one"], 10)
    assert few == [0, 1, 2, 3, 4, 5] and np.allclose(many, np.percentile(np.arange(1000), np.arange(10, 100, 10))) and one == []


def test_bins(spark):
    rng = np.random.default_rng(12)
    x = np.append(rng.normal(size=200), [0.0, 1.0, -1.0])
    for n in (0, 1, 5, 32, 33, 100, 255):
        cuts = sorted({0.0, *rng.normal(size=max(n - 1, 0))}) if n else []
        got = [r["b_0"] for r in binned(rows(spark, [(v,) for v in x], ["a"]), ["a"], [cuts]).orderBy("id").collect()]
        assert got == np.searchsorted(cuts, x).tolist()


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(2)
    df = rows(spark, [*rng.normal(size=(400, 2)), (8, 8), (-9, 7), (0, 12)], ["a", "b"])
    m = IsolationForest(["a", "b"], n_estimators=40, max_samples=64, contamination=0.01).fit(df)
    top = [r["id"] for r in m.decision_function(df).orderBy(F.desc("anomaly")).limit(3).collect()]
    assert sorted(top) == [400, 401, 402] and all(len(t) > 1 for t in m.nodes.values()) and len(m.nodes) == 40
    one = IsolationForest(["a", "b"], n_estimators=8, max_samples=32, max_features=0.5).fit(df)
    assert all(len({f for f in t["feature"] if f >= 0}) == 1 for t in one.nodes.values())


def test_silhouette_of_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(12, 2)), rng.normal(4, 1, (8, 2)), [[9, 9]]])
    c = np.array([0] * 12 + [1] * 8 + [2])
    df = rows(spark, np.column_stack([x, c]), ["a", "b", "c"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(len(x)):
        mean = [d[i, (c == k) & (np.arange(len(x)) != i)].mean() if ((c == k) & (np.arange(len(x)) != i)).any() else np.nan for k in range(3)]
        a, b = mean[c[i]], np.nanmin([m for k, m in enumerate(mean) if k != c[i]])
        want.append(0 if np.isnan(a) else (b - a) / max(a, b))
    got = {r["id"]: r["silhouette"] for r in metrics.pairwise_silhouette(df, ["a", "b"], "c", "id").collect()}
    assert np.allclose([got[i] for i in range(len(x))], want)


def test_cophenetic_correlation(spark):
    x = np.random.default_rng(5).normal(size=(9, 2))
    df = rows(spark, x, ["a", "b"])
    m = Agglomerative(["a", "b"], 2, "average").fit(df)
    own, height = {i: [i] for i in range(9)}, np.zeros((9, 9))
    for step, (a, b, h, _) in enumerate(m.merges):
        for i in own[a]:
            for j in own[b]:
                height[i, j] = height[j, i] = h
        own[9 + step] = own.pop(a) + own.pop(b)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    up = np.triu_indices(9, 1)
    assert m.cophenetic_correlation(df) == pytest.approx(np.corrcoef(d[up], height[up])[0, 1])


def test_random_start_and_unknown_init(spark):
    df = rows(spark, np.random.default_rng(6).normal(size=(40, 2)), ["a", "b"])
    m = KMeans(["a", "b"], 4, init="random").fit(df)
    assert len(m.centers) == 4 and np.allclose(m.centers, KMeans(["a", "b"], 4, init="random").fit(df).centers)
    with pytest.raises(ValueError):
        KMeans(["a", "b"], 4, init="else").fit(df)


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(7)
    x, q = rng.integers(0, 4, (60, 2)), rng.integers(0, 4, (11, 2))
    for metric in ("euclidean", "manhattan", "cosine"):
        m = NearestNeighbors(["a", "b"], k=5, distance_metric=metric, block=9).fit(rows(spark, np.column_stack([x + 1, x[:, 0]]), ["a", "b", "label"]))
        got = m.neighbors(rows(spark, q + 1, ["a", "b"])).orderBy("id", "rank").collect()
        for i, p in enumerate(q + 1):
            y = (x + 1).astype(float)
            d = {"euclidean": np.sqrt(((y - p) ** 2).sum(1)), "manhattan": np.abs(y - p).sum(1), "cosine": 1 - y @ p / (np.sqrt((y * y).sum(1)) * np.sqrt((p * p).sum()) + 1e-10)}[metric]
            assert np.allclose([r["distance"] for r in got if r["id"] == i], np.sort(d)[:5])
            if metric != "cosine":
                assert [r["tid"] for r in got if r["id"] == i] == np.lexsort((np.arange(60), d))[:5].tolist()


def test_layout_step_by_step(spark):
    x = np.random.default_rng(8).normal(size=(14, 2))
    df = rows(spark, x, ["a", "b"])
    m = Tsne(["a", "b"], perplexity=4, n_iter=3, early_iter=2, learning_rate=10.0)
    got = np.array([[r["y_0"], r["y_1"]] for r in m.fit_transform(df).orderBy("id").collect()])
    points = df.select(F.col("id").cast("long").alias("i"), F.array("a", "b").alias("x"))
    p = np.zeros((14, 14))
    for r in m.affinities(points).collect():
        p[r["i"], r["j"]] = r["p"]
    assert p.sum() == pytest.approx(1, abs=1e-9)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    cond = np.zeros_like(p)
    for i in range(14):
        own = np.arange(14) != i
        lo, hi = 1e-6, 1e6
        for _ in range(200):
            beta = np.sqrt(lo * hi)
            w = np.exp(-beta * (d2[i, own] - d2[i, own].min()))
            w /= w.sum()
            if -(w * np.log2(np.maximum(w, 1e-300))).sum() > 2:
                lo = beta
            else:
                hi = beta
        cond[i, own] = w
    assert np.allclose(p, np.maximum((cond + cond.T) / 28, 1e-12) * (1 - np.eye(14)), atol=1e-5)
    y = np.array([r["y"] for r in _start(points, 2, 1e-4, 0).orderBy("i").collect()])
    v = np.zeros_like(y)
    for t in range(3):
        boost, momentum = (12.0, 0.5) if t < 2 else (1.0, 0.8)
        gap = y[:, None] - y[None]
        w = 1 / (1 + (gap**2).sum(2))
        np.fill_diagonal(w, 0)
        g = 4 * ((boost * p - np.maximum(w / w.sum(), 1e-12)) * (1 - np.eye(14)) * w)[:, :, None] * gap
        v = momentum * v - 10 * g.sum(1)
        y = y + v
    assert np.allclose(got, y, atol=1e-9)


def test_factors_learn_and_stop(spark):
    rng = np.random.default_rng(9)
    u, v = rng.normal(size=(12, 2)), rng.normal(size=(9, 2))
    df = spark.createDataFrame([(i, j, float(np.clip(3 + u[i] @ v[j], 1, 5))) for i in range(12) for j in range(9) if (i * 7 + j) % 4], "user long, item long, rating double")
    m = MatrixFactorization(2, learning_rate=0.02, n_epochs=6).fit(df)
    assert all(b < a for a, b in zip(m.losses, m.losses[1:])) and m.predict(df).where("prediction is null").count() == 0
    cold = m.predict(spark.createDataFrame([(99, 1), (1, 99)], "user long, item long")).collect()
    assert all(r["prediction"] == pytest.approx(m.mean) for r in cold)
    known = {(r["user"], r["item"]) for r in df.collect()}
    found = m.recommend(df.select("user").distinct(), 2).collect()
    assert not {(r["user"], r["item"]) for r in found} & known
    assert len(MatrixFactorization(2, learning_rate=3.0, n_epochs=9, patience=1).fit(df).losses) < 9


def test_topics_keep_all_tokens(spark):
    df = spark.createDataFrame([(d, t, c) for d in range(8) for t, c in ((("apple", 4), ("pear", 3)) if d % 2 else (("iron", 5), ("zinc", 2)))], "doc long, term string, cnt long")
    m = TopicModel(2, max_iter=8).fit(df)
    top = {}
    for r in m.get_top_words(2).collect():
        top.setdefault(r["topic"], set()).add(r["term"])
    assert len(top) == 2 and all(len(t) == 2 for t in top.values())


def test_forecast_against_least_squares(spark):
    rng = np.random.default_rng(10)
    t = np.arange(400)
    y = 5 + 0.02 * t + np.sin(2 * np.pi * t / 7) + 0.1 * rng.normal(size=400)
    df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=int(k)), float(v)) for k, v in zip(t, y)], "ds date, y double")
    m = AdditiveForecast(3, yearly_fourier_order=2).fit(df)
    x = [np.ones(400), t, *(np.maximum(0, t - c) for c in m.changepoints)]
    for order, period in ((2, 365.25), (3, 7)):
        x += [f(2 * np.pi * i * t / period) for i in range(1, order + 1) for f in (np.cos, np.sin)]
    x = np.column_stack(x)
    want = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    got = [r["yhat"] for r in m.predict(df).orderBy("ds").collect()]
    assert np.allclose(got, want, atol=1e-5)
    grown = AdditiveForecast(0, yearly_seasonality=False, weekly_seasonality=False, cap=20.0).fit(df)
    assert all(0 < r["yhat"] < 20 for r in grown.predict(df).collect()) and grown.score(df) > 0.8


def test_scores_over_a_stream(spark, tmp_path):
    df = rows(spark, [(x, 3 * x + 1) for x in range(10)], ["x", "label"])
    m = LeastSquares(["x"]).fit(df)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, m.predict, str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    q.awaitTermination(120)
    assert all(r["prediction"] == pytest.approx(r["label"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    events = df.selectExpr("timestamp_seconds(id * 1200) as ts", "cast(id % 2 as string) as k", "x as v")
    assert sum(r["n"] for r in windowed_mean(events, "ts", "k", "v").collect()) == 10


def test_path_correction():
    assert path_correction(2) == 1 and path_correction(1) == 0
