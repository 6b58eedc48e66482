"""Metrics as one-row or grouped aggregates.  A null label or prediction leaves a row out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import rotated, running
from .prepare import draw


def first(df: DataFrame):
    return df.first()[0]


def r2(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float | None:
    """1 - SSres / SStot in one pass; None where the label is constant."""
    r = df.where(f"{label} is not null and {prediction} is not null").agg(F.expr(f"sum(pow({label} - {prediction}, 2))").alias("res"), F.expr(f"var_pop({label}) * count({label})").alias("tot")).first()
    return None if not r["tot"] else 1 - r["res"] / r["tot"]


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float | None:
    return first(df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double"))))


def rmse(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float | None:
    return first(df.agg(F.expr(f"sqrt(avg(pow({label} - {prediction}, 2)))")))


def mae(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float | None:
    return first(df.agg(F.expr(f"avg(abs({label} - {prediction}))")))


def log_loss(df: DataFrame, label: str = "label", probability: str = "probability", eps: float = 1e-15) -> float | None:
    p = f"least(greatest({probability}, {eps}D), 1 - {eps}D)"
    return first(df.agg(F.expr(f"-avg({label} * ln({p}) + (1 - {label}) * ln(1 - {p}))")))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def precision_recall(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of the class 1."""
    counts = df.agg(*[F.expr(f"count_if({label} = {a} and {prediction} = {b})").alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0))])
    return counts.select("*", F.expr("tp / nullif(tp + fp, 0)").alias("precision"), F.expr("tp / nullif(tp + fn, 0)").alias("recall"), F.expr("2 * tp / nullif(2 * tp + fp + fn, 0)").alias("f1"))


def ndcg(df: DataFrame, query: str, relevance: str, score: str, key: str, k: int | None = None) -> DataFrame:
    """(query, dcg, idcg, ndcg): gains 2^rel - 1 over log2(position + 1); 0 where no gain is possible; ties by key."""
    by = Window.partitionBy(query)
    ranked = df.select(query, relevance, F.row_number().over(by.orderBy(F.desc(score), key)).alias("p"), F.row_number().over(by.orderBy(F.desc(relevance), key)).alias("q"))
    gain = lambda at: F.expr(f"sum({f'case when {at} <= {k} then ' if k else ''}(pow(2, {relevance}) - 1) / log2({at} + 1){' else 0 end' if k else ''})")
    out = ranked.groupBy(query).agg(gain("p").alias("dcg"), gain("q").alias("idcg"))
    return out.withColumn("ndcg", F.expr("case when idcg = 0 then 0D else dcg / idcg end"))


def ranking(df: DataFrame, query: str, relevant: str, score: str, key: str, k: int = 10) -> DataFrame:
    """(query, average_precision, reciprocal_rank, precision_at_k, recall_at_k) of binary relevance."""
    w = Window.partitionBy(query).orderBy(F.desc(score), key)
    ranked = df.select(query, F.col(relevant).cast("int").alias("rel"), F.row_number().over(w).alias("p"), F.sum(F.col(relevant).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))
    return ranked.groupBy(query).agg(
        F.expr("coalesce(sum(rel * hits / p) / nullif(sum(rel), 0), 0D)").alias("average_precision"),
        F.expr("coalesce(1 / min(case when rel = 1 then p end), 0D)").alias("reciprocal_rank"),
        F.expr(f"sum(case when p <= {k} then rel else 0 end) / {k}").alias("precision_at_k"),
        F.expr(f"coalesce(sum(case when p <= {k} then rel else 0 end) / nullif(sum(rel), 0), 0D)").alias("recall_at_k"),
    )


def adjusted_rand(df: DataFrame, a: str, b: str) -> float:
    """From the contingency table alone."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = F.expr("sum(n * (n - 1) / 2)")
    both, n = cells.agg(pairs, F.sum("n")).first()
    in_a, in_b = (first(cells.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs)) for c in (a, b))
    expected = in_a * in_b / (n * (n - 1) / 2)
    top = (in_a + in_b) / 2
    return 1.0 if top == expected else (both - expected) / (top - expected)


def silhouette(df: DataFrame, features: list[str], cluster: str) -> float | None:
    """Mean simplified silhouette: distances to cluster centers, so one join with as many rows as clusters."""
    centers = df.groupBy(cluster).agg(*[F.avg(f).alias(f"c_{f}") for f in features]).withColumnRenamed(cluster, "other")
    d = F.sqrt(sum(((F.col(f) - F.col(f"c_{f}")) ** 2 for f in features), F.lit(0.0)))
    rows = df.withColumn("row_", F.monotonically_increasing_id()).crossJoin(F.broadcast(centers)).withColumn("d", d)
    each = rows.groupBy("row_").agg(F.min(F.when(F.col(cluster) == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col(cluster) != F.col("other"), F.col("d"))).alias("b"))
    return first(each.agg(F.expr("avg((b - a) / nullif(greatest(a, b), 0))")))


def pairwise_silhouette(df: DataFrame, features: list[str], cluster: str, key: str, block: int = 4096) -> DataFrame:
    """(key, cluster, silhouette) from the mean distances to all other rows of each cluster; 0 for a row alone in its cluster.

    Works on all pairs by nature, block by block: blocks of rows meet blocks of rows, a task each, and only a row's sums
    by cluster leave it, so pairs are never rows.  A row without a cluster or a feature gets 0 and counts for no other.
    silhouette() is linear.
    """
    rows = df.select(F.col(key).alias("i"), F.col(cluster).alias("c"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    usable = " and ".join(["i is not null", "c is not null", *(f"x[{k}] is not null" for k in range(len(features)))])
    rows, bad = rows.where(usable), rows.where(f"i is not null and not ({usable})")
    parts = max(1, -(-rows.count() // block))
    every, held = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), F.pmod(F.xxhash64("i", F.lit(23)), F.lit(parts)).cast("int")
    both = rows.select("*", held.alias("a"), every.alias("b"), F.lit(True).alias("own")).unionByName(rows.select("*", held.alias("b"), every.alias("a"), F.lit(False).alias("own")))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("i", "c")]
    sums = both.groupBy("a", "b").applyInPandas(_distance_sums, f"i {kinds[0]}, c {kinds[1]}, k {kinds[1]}, n long, d double")
    mean = sums.groupBy("i", "c", "k").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).where("n > 0").withColumn("d", F.col("d") / F.col("n"))
    each = mean.groupBy("i", "c").agg(F.min(F.when(F.col("c") == F.col("k"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("k"), F.col("d"))).alias("b"))
    each = each.unionByName(bad.select("i", "c"), allowMissingColumns=True)
    return each.select(F.col("i").alias(key), F.col("c").alias(cluster), F.expr("coalesce((b - a) / nullif(greatest(a, b), 0), 0D)").alias("silhouette"))


def _distance_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each row of a block: how many others of each cluster the other block has, and the sum of their distances."""
    own, other = rows[rows["own"]], rows[~rows["own"]].sort_values(["c", "i"])
    out = []
    if len(own) and len(other):
        j, y = other["i"].to_numpy(), np.stack(other["x"].to_numpy())
        code, kinds = pd.factorize(other["c"], use_na_sentinel=False)
        begins = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        for lo in range(0, len(own), 256):
            part = own.iloc[lo : lo + 256]
            i, x = part["i"].to_numpy(), np.stack(part["x"].to_numpy())
            d = np.zeros((len(i), len(j)))
            for f in range(x.shape[1]):
                gap = x[:, f, None] - y[None, :, f]
                d += gap * gap
            d, same = np.sqrt(d), i[:, None] == j[None]
            d[same] = 0.0
            n = np.diff(np.append(begins, len(j)))[None] - np.add.reduceat(same, begins, axis=1, dtype=np.int64)
            total, m = np.add.reduceat(d, begins, axis=1), len(begins)
            out.append(pd.DataFrame({"i": np.repeat(i, m), "c": np.repeat(part["c"].to_numpy(), m), "k": np.tile(np.asarray(kinds)[code[begins]], len(i)), "n": n.ravel(), "d": total.ravel()}))
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("i", "c", "k", "n", "d")})


def two_sample_ks(df: DataFrame, value: str, sample: str) -> float:
    """Greatest distance of the two samples' distribution functions; sample holds 0 and 1."""
    counts = df.groupBy(value).agg(F.sum(F.when(F.col(sample) == 0, 1).otherwise(0)).alias("x"), F.sum(F.when(F.col(sample) == 1, 1).otherwise(0)).alias("y"))
    total = counts.agg(F.sum("x"), F.sum("y")).first()
    steps = running(counts, [value], {"at_x": "x", "at_y": "y"})
    return first(steps.agg(F.max(F.abs(F.col("at_x") / total[0] - F.col("at_y") / total[1]))))


def permutation_importance(df: DataFrame, features: list[str], loss, key: str, seed: int = 0) -> dict[str, float]:
    """How much loss(rows) rises when a feature's values are dealt anew among the rows, in the order of a hash of the key."""
    base = loss(df)
    shuffled = df.withColumn("draw_", F.expr(draw(key, seed)))
    order = ["draw_", key, *(c for c in df.columns if c != key)]  # rows that tie are equal
    return {f: loss(rotated(shuffled, order, f)) - base for f in features}


def grid_search(options: list[dict], evaluate) -> list[tuple[dict, float]]:
    """(option, evaluate(**option)) from the greatest value down; each evaluation is a distributed job of its own."""
    return sorted(((o, evaluate(**o)) for o in options), key=lambda x: -x[1])


def ordered_target_statistic(df: DataFrame, category: str, target: str, order: str, prior: float = 0.5, count: float = 1.0) -> DataFrame:
    """df with target_statistic: (sum of earlier targets of the category + prior * count) / (their number + count)."""
    w = Window.partitionBy(category).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("target_statistic", (F.coalesce(F.sum(target).over(w), F.lit(0)) + prior * count) / (F.count(target).over(w) + count))
