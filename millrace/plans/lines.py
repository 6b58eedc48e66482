"""The line items that most estimator queries are fitted on, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with a key, scaled features and labels."""
    return read(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as id", "l_quantity / 50 as q", "l_discount * 10 as d", "l_tax * 10 as t", "l_extendedprice / 10000 as price", "case when l_returnflag = 'R' then 1 else 0 end as label", "l_returnflag as flag", "l_linestatus as status")


LINES = "l as (select l_orderkey * 10 + l_linenumber as id, l_quantity / 50 as q, l_discount * 10 as d, l_tax * 10 as t, l_extendedprice / 10000 as price, case when l_returnflag = 'R' then 1 else 0 end as label, l_returnflag as flag, l_linestatus as status from lineitem)"
