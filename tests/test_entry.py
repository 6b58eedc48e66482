import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events".split()
DIR = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["ols_simple", "ridge", "kmeans", "association_rules", "ndcg_at_10", "tree_root_split", "adaboost_rounds", "xgboost_stump", "lightgbm_stump", "catboost_stump", "lambda_gradients", "hidden_markov_forward", "trend", "quantization", "return_bins", "noise_removal", "logistic_growth", "pairwise_silhouette", "multinomial_bayes", "tree_entropy", "random_forest"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = c.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DIR).toPandas()
    order = sorted(want.columns)
    assert order == sorted(got.columns)
    a, b = (x[order].sort_values(order).reset_index(drop=True) for x in (want, got))
    assert a.astype(str).values.tolist() == b.astype(str).values.tolist()
