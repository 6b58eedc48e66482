"""Approximate neighbour graphs by descent: the neighbours of a row's neighbours are likely its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import array_distance
from ..functions.ordered import numbered
from .clustering import distances
from .loop import removed, written


def _introduced(k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each row's list: pairs of members, one of them new, that come nearer to each other than their farthest so far.
        Lists of one length are worked out together."""
        for batch in batches:
            lists = batch.column("members")
            ends, members = lists.offsets.to_numpy(), lists.values
            i, new, worst = (members.field(c).to_numpy(zero_copy_only=False) for c in ("j", "new", "worst"))
            x = members.field("x").flatten().to_numpy().reshape(len(i), -1)
            size, out = np.diff(ends), []
            for n in np.unique(size[size > 1]):
                of = np.flatnonzero(size == n)
                for part in np.array_split(of, -(-len(of) * n * n // (1 << 20))):
                    at = ends[part, None] + np.arange(n)
                    d = _among(x[at], metric)
                    own = i[at]
                    apart = (own[:, :, None] != own[:, None]) & (d < worst[at][:, :, None]) & (new[at][:, :, None] | new[at][:, None])
                    d[~apart] = np.inf
                    near = np.argsort(d, axis=2, kind="stable")[:, :, :k]
                    d = np.take_along_axis(d, near, 2)
                    row, col, _ = found = np.nonzero(np.take_along_axis(apart, near, 2))
                    out.append((own[row, col], own[row, near[found]], d[found]))
            yield pa.record_batch([pa.array(np.concatenate([o[c] for o in out]) if out else np.zeros(0, t)) for c, t in enumerate((np.int64, np.int64, float))], names=["i", "j", "d"])

    return run


def _among(x: np.ndarray, metric: str) -> np.ndarray:
    """The distances among the rows of each x[n]."""
    if metric == "cosine":
        return np.stack([distances(own, own, metric) for own in x])
    d = np.zeros((len(x), x.shape[1], x.shape[1]))
    for f in range(x.shape[2]):
        gap = x[:, :, None, f] - x[:, None, :, f]
        d += gap * gap if metric == "euclidean" else np.abs(gap)
    return np.sqrt(d) if metric == "euclidean" else d


def neighbour_descent(points: DataFrame, k: int, metric: str = "euclidean", rounds: int = 12, share: float = 0.001, seed: int = 0) -> DataFrame:
    """(i, j, d): about the k nearest of each row of points (i: long, unique, x: array of double), all others where they are fewer.

    Lists start from random rows.  In each round the members of a row's list, and at most k rows that have it in theirs,
    are introduced to each other, unless both are old, and each keeps its k nearest: joins and grouped lists
    of at most 2k members, so that no row, however many lists it is in, gathers more.  It ends when fewer than `share` of
    the entries change.  A test measures the recall; NearestNeighbors is the exact way, by blocks of all pairs.
    """
    ids = written(numbered(points.select("i"), ["i"], "at").withColumn("at", F.col("at") - 1))
    n = ids.count()
    k = min(k, max(n - 1, 0))
    if not k:
        return points.sparkSession.createDataFrame([], "i long, j long, d double")
    # The row itself is passed over; draws that repeat leave a list short at first.
    drawn = ids.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(k + 2)))).select("i", F.expr(f"(at + 1 + pmod(xxhash64({seed}, i, s), {n - 1})) % {n}").alias("at")).distinct()
    start = drawn.join(ids.withColumnRenamed("i", "j"), "at").select("i", "j")
    vectors = points.select(F.col("i").alias("j"), F.col("x").cast("array<double>").alias("x"))
    w = Window.partitionBy("i").orderBy("d", "j")

    def nearest(rows: DataFrame) -> DataFrame:
        return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")

    first = start.join(vectors, "j").join(vectors.select(F.col("j").alias("i"), F.col("x").alias("y")), "i")
    state = written(nearest(first.select("i", "j", F.expr(array_distance("x", "y", metric)).alias("d"), F.lit(True).alias("new"))))
    for t in range(rounds):
        back = state.select(F.col("j").alias("i"), F.col("i").alias("j"), "new").withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.xxhash64(F.lit(t), "i", "j"), "j"))).where(F.col("r") <= k).drop("r")
        both = state.select("i", "j", "new").unionByName(back).groupBy("i", "j").agg(F.max("new").alias("new"))
        worst = state.groupBy(F.col("i").alias("j")).agg(F.max("d").alias("worst"), F.count("*").alias("held"))
        told = both.join(vectors, "j").join(worst, "j", "left").withColumn("worst", F.when(F.col("held") >= k, F.col("worst")).otherwise(float("inf")))
        lists = told.groupBy("i").agg(F.collect_list(F.struct("j", "x", "new", "worst")).alias("members")).select("members")
        found = lists.mapInArrow(_introduced(k, metric), "i long, j long, d double").withColumn("new", F.lit(True))
        old = state.withColumn("new", F.lit(False))
        merged = found.unionByName(old).groupBy("i", "j").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        last, state = state, written(nearest(merged))
        removed(last)
        if state.where("new").count() <= share * n * k:
            break
    removed(ids)
    return state.select("i", "j", "d")
