import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import prepare
from millrace.operators import ranking
from millrace.operators.embedding import IsolationForest
from millrace.operators.linear import AdditiveForecast, LeastSquares
from millrace.plans import preparation

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["scaling", "power_transform", "chi_square", "one_hot", "topic_coherence", "gradient_sample", "prediction_interval", "diversified_ranking", "customer_split"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in "part orders lineitem customer documents".split():
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want, got = c.execute(preparation.ORACLE[name]).df(), preparation.QUERIES[name](spark, DIR).toPandas()
    order = sorted(want.columns)
    a, b = (x[order].astype(str).sort_values(order).values.tolist() for x in (want, got))
    assert a == b


def test_scaling_of_constant_and_empty(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (None, 6.0)], ["a", "b"])
    rows = prepare.scale(df, ["a", "b"], "minmax").orderBy("b").collect()
    assert [r["b_scaled"] for r in rows] == [0, 0.5, 1] and [r["a_scaled"] for r in rows] == [0, 0, None]
    assert prepare.scale(df.limit(0), ["a"]).count() == 0
    with pytest.raises(ValueError):
        prepare.scale(df, ["a"], "other")


def test_power_is_continuous_and_recovers_log(spark):
    x = np.exp(np.random.default_rng(0).normal(size=400))
    df = spark.createDataFrame([(float(v),) for v in x], ["x"])
    assert abs(prepare.power_exponent(df, "x", "box-cox")) <= 0.2
    r = df.select(F.expr(prepare.power("x", 1.0)).alias("y"), "x").first()
    assert r["y"] == pytest.approx(r["x"])


def test_encodings(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert sorted((str(r["c"]), r["c_code"]) for r in prepare.label_encode(df, "c").collect()) == [("None", None), ("a", 0), ("b", 1), ("b", 1)]
    assert [tuple(r)[1:] for r in prepare.one_hot(df, "c").orderBy(F.col("c").asc_nulls_first()).collect()] == [(0, 0), (1, 0), (0, 1), (0, 1)]
    with pytest.raises(ValueError):
        prepare.levels(df, "c", 1)


def test_terms(spark):
    df = spark.createDataFrame([(1, "The CAT see http://x.y/z the cat"), (2, None), (3, ""), (4, "cat")], "id long, text string")
    got = {(r["id"], r["term"]): r["cnt"] for r in prepare.terms(df, "id", "text", 2, ("the",)).collect()}
    assert got == {(1, "cat"): 2, (1, "see"): 1, (1, "cat see"): 1, (1, "see cat"): 1, (4, "cat"): 1}
    assert [r["term"] for r in prepare.vocabulary(prepare.terms(df, "id", "text"), "id", 4, min_df=2).collect()] == ["cat"]


def test_splits_are_whole(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    train, test = prepare.split(df, "id", 0.2)
    assert train.count() + test.count() == 1000 and 130 < test.count() < 270
    assert {r["fold"] for r in prepare.folds(df, "id", 4).collect()} == {0, 1, 2, 3}
    late = prepare.split_time(df, "id", 0.25).where("is_test").agg(F.min("id"), F.count("*")).first()
    assert late[0] >= 748 and 248 <= late[1] <= 251
    kept = prepare.goss(df.withColumn("x", F.col("id") - 500.0), "x", "id", 0.2, 0.1)
    assert kept.agg(F.sum("weight")).first()[0] == pytest.approx(1000, rel=0.25)
    assert prepare.split_groups(df, "g", ["id"]).where("is_test").groupBy("g").count().agg(F.min("count"), F.max("count")).first() == (28, 28)


def test_diversify_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(q, i, float(rng.normal()), [float(x) for x in rng.normal(size=3)]) for q in range(3) for i in range(7)]
    got = {}
    for r in ranking.diversify(spark.createDataFrame(rows, ["q", "id", "s", "v"]), "q", "id", "s", "v", 9, 0.6).collect():
        got.setdefault(r["q"], {})[r["rank"]] = r["id"]
    for q in range(3):
        left, chosen = {i: (s, np.array(v)) for k, i, s, v in rows if k == q}, []
        cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
        while left:
            best = max(left, key=lambda i: left[i][0] if not chosen else 0.6 * left[i][0] - 0.4 * max(cos(left[i][1], v) for v in chosen))
            got_id = got[q][len(chosen) + 1]
            assert got_id == best
            chosen.append(left.pop(best)[1])


def test_interval_covers(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(x), float(3 + 2 * x + rng.normal())) for x in rng.uniform(0, 9, 500)], ["x", "label"])
    inside = LeastSquares(["x"]).fit(df).interval(df).agg(F.avg(F.expr("case when label between lower and upper then 1D else 0D end"))).first()[0]
    assert 0.92 < inside < 0.98


def test_folds_in_time_and_explanations(spark):
    days = spark.range(200).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("ds"), (F.col("id") * 2.0).alias("y"))
    found = AdditiveForecast(0, yearly_seasonality=False).cross_validate(days, 2, 10)
    assert [n for n, _ in found] == [180, 190] and all(e < 1e-6 for _, e in found)
    rows = spark.createDataFrame([(i, float(i % 5), 50.0 if i == 3 else float(i % 7)) for i in range(300)], ["id", "a", "b"])
    m = IsolationForest(["a", "b"], n_estimators=20).fit(rows)
    r = m.explain(rows).where("id = 3").first()
    assert r["b_share"] > r["a_share"] and r["b"] == 50
