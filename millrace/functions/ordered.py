"""Row numbers and running sums over a whole table, range by range instead of in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.loop import written


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with each name of sums: the sum of its SQL text over all rows up to this one in order.

    Rows are dealt into ranges of the order and written; the totals of the ranges, a row each, give what comes before a
    range.  Rows that are equal in order go to one range, so order should nearly tell rows apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"value_{k}": F.expr(e) for k, e in enumerate(sums.values())}
    placed = written(df.withColumns(values).repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()))
    totals = {r[0]: list(r)[1:] for r in placed.groupBy("range_").agg(*[F.sum(v) for v in values]).collect()}
    before, rows = [0] * len(values), []
    for at in range(parts):
        if at in totals:
            rows.append((at, *map(float, before)))
            before = [b + (t or 0) for b, t in zip(before, totals[at])]
    offsets = df.sparkSession.createDataFrame(rows, ", ".join(["range_ int", *(f"before_{k} double" for k in range(len(values)))]))
    w = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "range_")
    return out.withColumns({n: F.sum(v).over(w) + F.col(f"before_{k}") for k, (n, v) in enumerate(zip(sums, values))}).drop("range_", *values, *[f"before_{k}" for k in range(len(values))])


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with the place of each row in order, from 1."""
    return running(df, order, {name: "1"}).withColumn(name, F.col(name).cast("long"))


def rotated(df: DataFrame, order: list[str], column: str, share: float = 0.5) -> DataFrame:
    """df with the column's values moved on by a share of the rows in order: a permutation that needs no sort in one task."""
    rows = written(numbered(df, order, "place_"))
    n = rows.count()
    moved = rows.select(((F.col("place_") - 1 + int(n * share)) % max(n, 1) + 1).alias("place_"), F.col(column).alias("moved_"))
    return rows.drop(column).join(moved, "place_").withColumnRenamed("moved_", column).drop("place_")


def before(df: DataFrame, group: str, place: str, sums: dict[str, str], chunk: int = 1 << 16) -> DataFrame:
    """df with each name of sums: the sum of its SQL text over the rows of the same group (null is one) with a smaller place.

    place numbers the rows of df.  Rows of a group are summed chunk by chunk of the numbers, then within a chunk, so that
    the rows of a frequent group don't meet in one task.
    """
    values = {f"value_{k}": F.expr(e) for k, e in enumerate(sums.values())}
    own = df.withColumns(values | {"chunk_": F.expr(f"{place} div {chunk}")})
    upto = Window.partitionBy("group_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    chunks = own.groupBy(F.col(group).alias("group_"), F.col("chunk_").alias("at_")).agg(*[F.sum(v).alias(v) for v in values])
    chunks = chunks.select("group_", "at_", *[F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(f"before_{v}") for v in values])
    out = own.join(chunks, F.col(group).eqNullSafe(F.col("group_")) & (F.col("chunk_") == F.col("at_")))
    w = Window.partitionBy(group, "chunk_").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumns({n: F.col(f"before_{v}") + F.coalesce(F.sum(v).over(w), F.lit(0)) for n, v in zip(sums, values)}).select(*df.columns, *sums)
