"""Tables, and the rows that estimators take from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str, kind: str = "parquet") -> DataFrame:
    """A table of any of Spark's formats (parquet, csv, json, orc)."""
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    return reader.load(f"{folder}/{name}.{kind}")


def baskets(rows: DataFrame, tid: str, item: str) -> DataFrame:
    return rows.selectExpr(f"{tid} as tid", f"{item} as item")


def sequences(rows: DataFrame, key: str, order: list[str], symbol: str) -> DataFrame:
    """(seq_id, symbols): the symbols of each key in order.  A sequence is one value of a row, as the recursions over it need
    it whole: keys with more than some ten million events should be cut by time first."""
    fields = ", ".join([*order, symbol])
    return rows.selectExpr(f"{key} as seq_id", f"struct({fields}) as s").groupBy("seq_id").agg({"s": "collect_list"}).selectExpr("seq_id", f"transform(array_sort(`collect_list(s)`), x -> cast(x.{symbol} as string)) as symbols")
