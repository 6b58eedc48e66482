from pyspark.sql import functions as F

from millrace.operators import ordered_boosting
from millrace.operators.ordered_boosting import OrderedBoosting


def test_the_last_tree_writes_margins_alone(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(ordered_boosting, "written", lambda df, f=ordered_boosting.written: kept.append(df.columns) or f(df))
    rows = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 2).alias("label"))
    m = OrderedBoosting(["x"], ["c"], n_estimators=2, max_depth=1).fit(rows)
    assert kept[-1] == ["id", "block_", "m_"] and "label" in kept[-2]
    assert m.margins.count() == 200 and len(m.trees) == 2
