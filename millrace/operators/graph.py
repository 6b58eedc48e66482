"""Components of links in tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loop import removed, written


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node reachable from each of n nodes by the links u-v, in numpy."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, nxt := label[label]):
            label = nxt
        keep = label[u] != label[v]
        u, v = u[keep], v[keep]
    return label


def _contract(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch -> links from each node to the least node that the batch joins it with."""
    for batch in tables:
        u, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = nodes[roots(len(nodes), at[: len(u)], at[len(u) :])]
        keep = root != nodes
        yield pa.record_batch([pa.array(nodes[keep]), pa.array(root[keep])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over links (u, v: long, no nulls); only nodes that have a link.

    Alternating large-star and small-star rounds; each is a few joins and partial aggregates, written
    to the shared folder, until the links no longer change.  Links are dealt by both ends, so that the
    links of a hub do not meet in one task, and those of a batch are contracted first.
    """
    edges = written(links.select("u", "v").where("u <> v").repartition("u", "v").mapInArrow(_contract, "u long, v long").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        removed(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
