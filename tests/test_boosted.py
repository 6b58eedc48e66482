"""The split kernel at its edges, ordered boosting, bundles, models as tables, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.ordered import before
from millrace.operators import trees
from millrace.operators.ordered_boosting import OrderedBoosting
from millrace.operators.trees import Boosting, DecisionTree, LambdaRank, RandomForest, Values, cut_points, entries, exclusive_bundles
from millrace.sources.models import load, save
from millrace.streaming.scoring import update_stream


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(rng.integers(0, 9)), float(rng.normal()), str(rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1])) if i % 50 else None) for i in range(600)]
    data = [(*r, float(r[1] > 4) if rng.random() < 0.9 else 0.0) for r in data]
    df = spark.createDataFrame(data, "id long, q double, x double, c string, y double").repartition(3).persist()
    df.count()
    return df


def shape(tree):
    return {n: (x.get("feature"), x.get("threshold")) for n, x in tree.items()}


def test_sums_of_earlier_rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, [None, "a", "a", "a", "b"][rng.integers(0, 5)], float(rng.integers(0, 9))) for i in range(300)]
    df = spark.createDataFrame(data, "place long, g string, v double").repartition(4)
    got = {r["place"]: (r["s"], r["n"]) for r in before(df, "g", "place", {"s": "v", "n": "1D"}, 16).collect()}
    assert got == {p: (sum(v for q, h, v in data if q < p and h == g), sum(q < p and h == g for q, h, _ in data)) for p, g, _ in data}


@pytest.mark.parametrize("exact", [10, 100_000])
def test_cut_points_on_both_sides_of_exact(spark, exact):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=4000), 3)
    few = rng.integers(0, 8, 4000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, few)], "x double, few double")
    cuts = cut_points(df, ["x", "few"], 16, exact)
    assert isinstance(cuts[1], Values) and cuts[1] == list(range(7)) and not isinstance(cuts[0], Values)
    want = np.quantile(x, np.arange(1, 16) / 16)
    shares = np.searchsorted(np.sort(x), cuts[0], side="right") / 4000
    assert len(cuts[0]) == 15 and np.abs(shares - np.arange(1, 16) / 16).max() < 0.002
    if exact > 10:
        assert np.allclose(cuts[0], want)


@pytest.mark.parametrize("limit", [1, 256])
def test_ways_by_text_and_by_lookup_agree(rows, monkeypatch, limit):
    monkeypatch.setattr(trees, "CASE_NODES", limit)
    t = DecisionTree(["q", "x"], "y", max_depth=4, task="regression", max_bins=16).fit(rows)
    m = Boosting.xgboost(["q", "x"], label="y", n_estimators=3, max_depth=3, max_bins=16).fit(rows)
    f = RandomForest(["q", "x"], "y", n_estimators=4, max_depth=3, task="regression", max_bins=16).fit(rows)
    key = [shape(t.tree), *map(shape, m.trees), *(shape(x.tree) for x in f.trees)]
    test_ways_by_text_and_by_lookup_agree.seen = getattr(test_ways_by_text_and_by_lookup_agree, "seen", key)
    assert key == test_ways_by_text_and_by_lookup_agree.seen and max(len(k) for k in key) > 8


def test_forest_jobs_do_not_grow_with_trees(spark, rows):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"forest {n}", "")
        RandomForest(["q", "x"], "y", n_estimators=n, max_depth=3, task="regression", max_bins=16).fit(rows)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest {n}"))

    few, many = jobs(2), jobs(12)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < many <= few + 2


def plain_ordered(data, m, splits):
    """Ordered boosting of (place order) rows with given splits: margins of each row's own model and of the last one."""
    n = len(data)
    block = [0 if r == 0 else r.bit_length() for r in range(n)]
    last = max(block) + 1
    start = lambda own: float(np.log((sum(own) + 0.5) / (len(own) + 1) / (1 - (sum(own) + 0.5) / (len(own) + 1)))) if own else 0.0
    margin = np.array([[start([data[i]["y"] for i in range(n) if block[i] < k])] * n for k in range(last + 1)])
    y = np.array([r["y"] for r in data])
    for tree in splits:
        leaf = []
        for r in data:
            node = 0
            while "feature" in tree[node]:
                node = 2 * node + (1 if r[m._columns()[tree[node]["feature"]]] <= tree[node]["threshold"] else 2)
            leaf.append(node)
        leaf = np.array(leaf)
        g = 1 / (1 + np.exp(-margin)) - y
        step = np.zeros_like(margin)
        for k in range(last + 1):
            for v in set(leaf.tolist()):
                own = [i for i in np.flatnonzero(leaf == v) if block[i] < k]
                if own:
                    step[k, leaf == v] = -m.learning_rate * g[k, own].sum() / (len(own) + m.reg_lambda)
        margin = margin + step
    return {data[i]["id"]: (margin[block[i], i], margin[last, i]) for i in range(n)}


def test_ordered_boosting_against_plain(spark, rows):
    make = lambda **kw: OrderedBoosting(["q", "x"], ["c"], "y", objective="logistic", n_estimators=3, learning_rate=0.4, max_depth=2, max_bins=8, **kw)
    m = make().fit(rows)
    data = [r.asDict() for r in m.ordered(rows).orderBy("place_").collect()]
    assert [r["place_"] for r in data] == list(range(600))
    for k, r in enumerate(data):  # means of earlier rows of the category
        own = [x["y"] for x in data[:k] if x["c"] == r["c"]]
        assert np.isclose(r["c_mean"], (sum(own) + 0.5) / (len(own) + 1))
    want = plain_ordered(data, m, m.trees)
    got = {r["id"]: (r["margin"], r["last"]) for r in m.margins.collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], [want[k] for k in want])
    assert m.score(rows) > 0.8
    # A row's margin does not depend on its own label nor on those of later rows; later rows' margins do on it.
    changed = data[37]
    other = rows.withColumn("y", F.when(F.col("id") == changed["id"], 1 - F.col("y")).otherwise(F.col("y")))
    moved = {r["id"]: r["margin"] for r in make().fit(other, m.trees).margins.collect()}
    same = [np.isclose(moved[r["id"]], got[r["id"]][0]) for r in data]
    assert all(same[:38]) and not all(same[64:])


def test_ordered_boosting_of_odd_rows(spark, rows):
    schema = "id long, q double, x double, c string, y double"
    odd = spark.createDataFrame([(1, 1.0, None, "a", 1.0), (2, 1.0, 2.0, None, None), (None, 1.0, 2.0, None, 1.0), (4, 2.0, 2.0, "b", 0.0), (4, 2.0, 2.0, "b", 0.0)], schema)
    with pytest.raises(ValueError, match="null"):
        OrderedBoosting(["q", "x"], ["c"], "y").fit(odd)
    m = OrderedBoosting(["q", "x"], ["c"], "y", n_estimators=2, max_depth=2).fit(odd.dropna(subset=["q", "x", "y"]))
    assert m.margins.count() == 3
    p = m.predict(spark.createDataFrame([(9, 1.0, 1.0, "new", None)], schema)).first()["prediction"]
    assert 0 <= p <= 1
    none = OrderedBoosting(["q"], [], "y", n_estimators=1).fit(rows.limit(0))
    assert none.margins.count() == 0 and none.predict(rows.limit(2)).count() == 2


def test_random_strength_changes_splits_reproducibly(rows):
    fit = lambda **kw: [shape(t) for t in Boosting.catboost(["q", "x"], label="y", n_estimators=3, max_depth=2, max_bins=16, **kw).fit(rows).trees]
    assert fit() == fit(random_strength=0.0) and fit(random_strength=50.0) == fit(random_strength=50.0) != fit()


def test_bundles_give_the_same_trees(spark):
    rng = np.random.default_rng(9)
    kind, other = rng.integers(0, 12, 1500), rng.integers(0, 5, 1500)
    q = np.round(rng.normal(size=1500), 2)
    y = (kind % 3) + (other == 2) + q + rng.normal(size=1500) * 0.1
    names = ["q", *(f"k{j}" for j in range(12)), *(f"o{j}" for j in range(5)), "z"]
    data = [(i, float(q[i]), *(float(kind[i] == j) for j in range(12)), *(-2.5 * float(other[i] == j) for j in range(5)), float(i % 40 == 0) * float(q[i]), float(y[i])) for i in range(1500)]
    df = spark.createDataFrame(data, "id long, " + ", ".join(f"{n} double" for n in names) + ", y double").persist()
    make = lambda bundle: Boosting.lightgbm(names, label="y", n_estimators=3, learning_rate=0.3, max_depth=4, max_bins=32, bundle=bundle).fit(df)
    plain, bundled = make(False), make(True)
    assert [shape(t) for t in plain.trees] == [shape(t) for t in bundled.trees] and max(map(len, plain.trees)) > 15
    cuts = cut_points(df, names, 32)
    own = exclusive_bundles(trees.binned(df, names, cuts), names, cuts)
    assert sorted(map(len, own)) == [5, 12] and bundled.bundles == own
    count = lambda b: df.select(F.expr(f"size(filter({entries(names, list(range(19)), [Values()] * 19, b)}, e -> e is not null))").alias("n")).agg(F.sum("n")).first()[0]
    assert count(None) == 1500 * 19 and count(own) == 1500 * 5  # q, z, one of each bundle, the totals
    some = exclusive_bundles(df, names, [Values()] * 19, 0.5, 2.0)
    assert len(some) == 1 and len(some[0]) == 18  # all conflicts allowed


@pytest.mark.parametrize("kind", ["boosting", "ranking"])
def test_models_are_written_read_and_added_to(spark, rows, tmp_path, kind):
    if kind == "boosting":
        model = Boosting.xgboost(["q", "x"], label="y", objective="logistic", n_estimators=2, max_depth=2, max_bins=16, bundle=True)
    else:
        model, rows = LambdaRank(["q", "x"], "y", "g", n_estimators=2, max_depth=2), rows.withColumn("g", F.col("id") % 7)
    model.fit(rows)
    save(spark, model, str(tmp_path / "m"))
    again = load(spark, str(tmp_path / "m"))
    assert again == model
    before_ = [shape(t) for t in model.trees]
    again.update(rows.where("id % 2 = 0"), 2)
    assert [shape(t) for t in again.trees[:2]] == before_ and len(again.trees) == 4
    if kind == "boosting":
        # As one fit of four trees, if the rows are the same.
        whole = Boosting.xgboost(["q", "x"], label="y", objective="logistic", n_estimators=4, max_depth=2, max_bins=16).fit(rows)
        model.update(rows, 2)
        assert [shape(t) for t in model.trees] == [shape(t) for t in whole.trees]
        assert np.allclose([r["prediction"] for r in model.predict(rows).orderBy("id").collect()], [r["prediction"] for r in whole.predict(rows).orderBy("id").collect()])
    assert again.predict(rows).count() == 600


def test_models_learn_from_streams(spark, rows, tmp_path):
    model = Boosting.xgboost(["q", "x"], label="y", n_estimators=1, max_depth=2, max_bins=16).fit(rows)
    folder = str(tmp_path / "m")
    save(spark, model, folder)
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        update_stream(stream, folder, 1, str(tmp_path / "c")).awaitTermination()
    assert len(load(spark, folder).trees) == 3
