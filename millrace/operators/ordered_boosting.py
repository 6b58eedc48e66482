"""Ordered boosting: trees with one split a level whose residuals come from models that saw only earlier rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.expr import num, sigmoid
from ..functions.ordered import before, numbered
from ..functions.prepare import draw
from .linear import complete
from .loop import removed, written
from .trees import Boosting, Tree, binned, cut_points, placed


@dataclass
class OrderedBoosting:
    """Boosting on a random order of the rows, a hash of (seed, key) and then the columns, in which no row's residual depends on its own label.

    Rows are numbered in that order; those numbered from 2^(b-1) to 2^b - 1 are block b (the first row is block 0).
    Model k learns from the blocks before k, and the residuals of block k, by which splits are chosen, are those of
    model k: of rows that all come earlier.  The trees of all models have the same splits and leaf values of their own, so
    a row keeps its margin for model b and for the later ones, which learn from it: half of the rows keep two, a quarter
    three.  The last model learns from all rows and is the one that predicts.

    A category is taken as the mean label of the earlier rows that share it, with prior_weight rows of the mean `prior`;
    in predictions, of all rows of the fit.  Null is a category, an unseen one has the prior.  A null feature or
    label is an error.  Of model 0, which learns from nothing, the margin is 0.  random_strength adds normal noise to
    the scores of splits, in parts of the residuals' deviation over the number of rows, less from tree to tree.
    """

    features: list[str]
    categories: list[str] = field(default_factory=list)
    label: str = "label"
    key: str = "id"
    objective: str = "squared"  # squared, logistic
    n_estimators: int = 100
    learning_rate: float = 0.03
    max_depth: int = 6
    reg_lambda: float = 3.0
    max_bins: int = 128
    prior: float = 0.5
    prior_weight: float = 1.0
    random_strength: float = 0.0
    seed: int = 0
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    statistics: dict[str, DataFrame] = field(default_factory=dict)
    margins: DataFrame | None = None  # key, block, margin of the block's model after the fit, last: that of the last model

    def _columns(self) -> list[str]:
        return [*self.features, *(f"{c}_mean" for c in self.categories)]

    def _mean(self, total: str, n: str) -> str:
        return f"(coalesce({total}, 0D) + {num(self.prior * self.prior_weight)}) / (coalesce({n}, 0D) + {num(self.prior_weight)})"

    def _start(self, total: float, n: int) -> float:
        if self.objective == "logistic":
            p = (total + 0.5) / (n + 1)
            return float(np.log(p / (1 - p)))
        return total / n if n else 0.0

    def ordered(self, df: DataFrame) -> DataFrame:
        """The rows of a fit with their number place_ (from 0), block_ and the means of earlier rows of their categories."""
        own = complete(df, [*self.features, self.label]).select(self.key, *self.features, *self.categories, F.col(self.label).cast("double").alias(self.label))
        rows = numbered(own.withColumn("draw_", F.expr(draw(self.key, self.seed))), ["draw_", self.key, self.label, *self.features, *self.categories], "place_").drop("draw_")
        rows = rows.withColumn("place_", F.col("place_") - 1).withColumn("block_", F.expr("if(place_ = 0, 0, length(bin(place_)))"))
        for c in self.categories:
            rows = before(written(rows), c, "place_", {"total_": self.label, "n_": "1D"}).withColumn(f"{c}_mean", F.expr(self._mean("total_", "n_"))).drop("total_", "n_")
        return rows

    def fit(self, df: DataFrame, splits: list[Tree] | None = None) -> OrderedBoosting:
        """splits: trees whose splits are taken in place of choosing them; the leaf values are learned anew."""
        if self.objective not in ("squared", "logistic"):
            raise ValueError(f"unknown objective {self.objective!r}")
        rows, names, y = written(self.ordered(df)), self._columns(), self.label
        self.statistics = {c: written(rows.groupBy(c).agg(F.sum(y).alias("total_"), F.count("*").cast("double").alias("n_"))) for c in self.categories}
        sums = {r[0]: (r[1], r[2]) for r in rows.groupBy("block_").agg(F.sum(y), F.count("*")).collect()}
        last = max(sums, default=0) + 1  # the model of all rows
        upto = [(sum(t for b, (t, _) in sums.items() if b < k), sum(n for b, (_, n) in sums.items() if b < k)) for k in range(last + 1)]
        bases = [self._start(*s) if s[1] else 0.0 for s in upto]
        self.base, self.trees = bases[-1], []
        cuts = cut_points(rows, names, self.max_bins)
        kept, rows = rows, written(binned(rows, names, cuts).withColumn("m_", F.slice(F.lit(np.array(bases)), F.col("block_") + 1, F.lit(last + 1))))
        removed(kept)
        shape = Boosting.catboost(names, label=y, max_depth=self.max_depth, reg_lambda=self.reg_lambda, random_strength=self.random_strength, seed=self.seed)
        gradient = lambda m: f"({sigmoid(m)} - {y})" if self.objective == "logistic" else f"({m} - {y})"
        rounds = self.n_estimators if splits is None else len(splits)
        for t in range(rounds):
            tree = splits[t] if splits is not None else shape._oblivious(rows, {"n": "1D", "g": gradient("m_[0]")}, cuts, t)
            places = placed(tree)
            at = places.found(rows, names)
            each = at.select("node_", "block_", y, F.posexplode(F.expr("slice(m_, 2, size(m_))")).alias("j", "m"))
            found = each.groupBy("node_", F.expr("block_ + 1 + j").alias("model")).agg(F.sum(F.expr(gradient("m"))).alias("g"), F.count("*").alias("n")).collect()
            values = np.zeros((last + 1, len(places.node)))
            for r in found:
                values[r["model"], r["node_"]] = -self.learning_rate * r["g"] / (r["n"] + self.reg_lambda)
            self.trees.append({node: ({k: x for k, x in tree[node].items() if k != "stats"} | {"value": float(values[last, p])}) for p, (_, node) in enumerate(places.node)})
            moved = at.withColumn("v_", F.lit(values.reshape(-1))).withColumn("m_", F.expr(f"transform(m_, (m, i) -> m + v_[(block_ + i) * {len(places.node)} + node_])")).drop("v_", "node_")
            # After the last tree only the margins are read.
            old, rows = rows, written(moved if t + 1 < rounds else moved.select(self.key, "block_", "m_"))
            removed(old)
        self.margins = rows.select(self.key, F.col("block_").alias("block"), F.expr("m_[0]").alias("margin"), F.expr("element_at(m_, -1)").alias("last"))
        return self

    def margin(self, df: DataFrame, n: int | None = None) -> DataFrame:
        """df with margin_ by the first n trees."""
        out = df
        for c in self.categories:
            own = self.statistics[c].select(F.col(c).alias("group_"), "total_", "n_")
            out = out.join(own, F.col(c).eqNullSafe(F.col("group_")), "left").withColumn(f"{c}_mean", F.expr(self._mean("total_", "n_"))).drop("group_", "total_", "n_")
        out = out.withColumn("margin_", F.lit(self.base))
        for tree in self.trees[:n]:
            places = placed(tree)
            values = F.lit(np.array([tree[node]["value"] for _, node in places.node]))
            out = places.found(out, self._columns()).withColumn("margin_", F.col("margin_") + values[F.col("node_")]).drop("node_")
        return out.drop(*(f"{c}_mean" for c in self.categories))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.margin(df).withColumn("prediction", F.expr(sigmoid("margin_") if self.objective == "logistic" else "margin_")).drop("margin_")

    def score(self, df: DataFrame) -> float | None:
        """Accuracy, or -RMSE."""
        p = self.predict(df)
        return metrics.accuracy(p.withColumn("c_", (F.col("prediction") >= 0.5).cast("int")), self.label, "c_") if self.objective == "logistic" else -metrics.rmse(p, self.label)
