"""k-means, Gaussian mixtures, agglomerative clustering, naive Bayes and nearest neighbours."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.expr import argmax, argmin, array_distance, dot, lse, num, squared_distance
from .linear import complete
from .loop import dealt, removed, written
from .merging import merges
from .regions import REGION, Regions, _home, _met, _visit


def spread(df: DataFrame, features: list[str], k: int, seed: int = 0, key: str | None = None) -> np.ndarray:
    """k starting points: each the row that is greatest in squared distance times a hash-drawn weight (k-means++ by
    exponential races), one aggregate a point; no row is drawn twice."""
    ident = F.xxhash64(F.lit(seed), *( [key] if key else features))
    first = df.orderBy(ident, *features).select(*features).first()
    points = [list(map(float, first))]
    while len(points) < k:
        d = f"least({', '.join(squared_distance(features, p) for p in points)})" if len(points) > 1 else squared_distance(features, points[0])
        draw = F.log((F.pmod(F.xxhash64(F.lit(seed + len(points)), *([key] if key else features)), F.lit(1 << 30)) + 1) / float((1 << 30) + 2))
        r = df.withColumn("d_", F.expr(d)).where("d_ > 0").orderBy(F.desc(draw / F.col("d_")), *features).select(*features).first()
        if r is None:
            break
        points.append(list(map(float, r)))
    return np.array(points)


@dataclass
class KMeans:
    features: list[str]
    n_clusters: int = 3
    max_iter: int = 300
    tol: float = 1e-4
    seed: int = 0
    initial: list[list[float]] | None = None
    init: str = "k-means++"  # or random: the rows least by a hash
    centers: np.ndarray | None = None
    n_iter: int = 0

    def fit(self, df: DataFrame) -> KMeans:
        """Lloyd's loop: a scan and a partial aggregate an iteration; an empty cluster keeps its center."""
        rows = dealt(complete(df, self.features).select(*self.features)).persist()
        if self.init not in ("k-means++", "random"):
            raise ValueError(f"unknown init {self.init!r}")
        if self.initial is not None:
            c = np.array(self.initial, float)
        elif self.init == "random":
            c = np.array(rows.distinct().orderBy(F.xxhash64(F.lit(self.seed), *self.features), *self.features).limit(self.n_clusters).collect(), float)
        else:
            c = spread(rows, self.features, self.n_clusters, self.seed)
        for self.n_iter in range(1, self.max_iter + 1):
            new = c.copy()
            for r in rows.groupBy(F.expr(self._nearest(c)).alias("k")).agg(*[F.avg(f) for f in self.features]).collect():
                new[r[0]] = r[1:]
            moved, c = np.abs(new - c).max(), new
            if moved < self.tol:
                break
        rows.unpersist()
        self.centers = c
        return self

    def _nearest(self, c) -> str:
        return f"cast({argmin([squared_distance(self.features, x) for x in c])} as int)"

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("cluster", F.expr(self._nearest(self.centers)))

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"distance_{i}": F.expr(f"sqrt({squared_distance(self.features, c)})") for i, c in enumerate(self.centers)})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def inertia(self, df: DataFrame) -> float:
        d = [squared_distance(self.features, c) for c in self.centers]
        return metrics.first(df.agg(F.expr(f"sum(least({', '.join(d)}))" if len(d) > 1 else f"sum({d[0]})")))

    def score(self, df: DataFrame) -> float:
        return -self.inertia(df)

    def get_cluster_centers(self) -> np.ndarray:
        return self.centers


@dataclass
class GaussianMixture:
    features: list[str]
    n_components: int = 3
    max_iter: int = 100
    tol: float = 1e-4
    covariance_type: str = "full"
    reg_covar: float = 1e-6
    seed: int = 0
    initial_means: list[list[float]] | None = None
    weights: np.ndarray | None = None
    means: np.ndarray | None = None
    covariances: np.ndarray | None = None  # k x d x d, whatever the type
    history: list[float] | None = None

    def _log_density(self) -> list[str]:
        """ln weight + ln N(x) of each component: squared lengths of whitened differences."""
        out, d = [], len(self.features)
        for w, m, s in zip(self.weights, self.means, self.covariances):
            half = np.linalg.inv(np.linalg.cholesky(s))
            z = " + ".join(f"pow({dot(self.features, row, -float(row @ m))}, 2)" for row in half)
            out.append(f"({num(np.log(w + 1e-300) - 0.5 * d * np.log(2 * np.pi) + np.log(np.diag(half)).sum())} - 0.5D * ({z}))")
        return out

    def fit(self, df: DataFrame) -> GaussianMixture:
        """EM: one aggregate of weighted moments an iteration, until the total log-likelihood moves less than tol."""
        if self.covariance_type not in ("full", "diag", "spherical", "tied"):
            raise ValueError(f"unknown covariance type {self.covariance_type!r}")
        f, d = self.features, len(self.features)
        rows = dealt(complete(df, f).select(*f)).persist()
        self.means = np.array(self.initial_means, float) if self.initial_means is not None else spread(rows, f, self.n_components, self.seed)
        k = len(self.means)
        self.weights, self.covariances, self.history = np.full(k, 1 / k), np.stack([np.eye(d)] * k), []
        pairs = [(a, b) for a in range(d) for b in range(a, d)]
        for _ in range(self.max_iter):
            names = [f"l_{i}" for i in range(k)]
            scored = rows.select(*f, *[F.expr(e).alias(n) for n, e in zip(names, self._log_density())]).withColumn("ll", F.expr(lse(names)))
            scored = scored.select(*f, "ll", *[F.expr(f"exp({n} - ll)").alias(n) for n in names])
            r = scored.agg(F.sum("ll"), F.count("*"), *[F.expr(f"sum({n}{e})") for n in names for e in ("", *(f" * {x}" for x in f), *(f" * {f[a]} * {f[b]}" for a, b in pairs))]).first()
            ll, n_rows, sums = r[0], r[1], np.array(r[2:], float).reshape(k, -1)
            nk = sums[:, 0] + 10 * np.finfo(float).eps
            self.weights, self.means = nk / n_rows, sums[:, 1 : 1 + d] / nk[:, None]
            for i in range(k):
                s = np.zeros((d, d))
                for (a, b), v in zip(pairs, sums[i, 1 + d :]):
                    s[a, b] = s[b, a] = v / nk[i] - self.means[i, a] * self.means[i, b]
                self.covariances[i] = s
            if self.covariance_type == "tied":
                self.covariances[:] = np.einsum("i,iab->ab", self.weights, self.covariances)
            elif self.covariance_type != "full":
                for i in range(k):
                    v = np.diag(self.covariances[i])
                    self.covariances[i] = np.diag(v if self.covariance_type == "diag" else np.full(d, v.mean()))
            self.covariances += self.reg_covar * np.eye(d)
            self.history.append(ll)
            if len(self.history) > 1 and abs(ll - self.history[-2]) < self.tol:
                break
        rows.unpersist()
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        names = [f"p_{i}" for i in range(len(self.means))]
        out = df.withColumns({n: F.expr(e) for n, e in zip(names, self._log_density())}).withColumn("log_density", F.expr(lse(names)))
        return out.withColumns({n: F.expr(f"exp({n} - log_density)") for n in names})

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("cluster", F.expr(f"cast({argmax(self._log_density())} as int)"))

    def score(self, df: DataFrame) -> float:
        """Total log-likelihood."""
        return metrics.first(self.predict_proba(df).agg(F.sum("log_density")))

    def n_parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + k * d + {"full": k * d * (d + 1) // 2, "diag": k * d, "spherical": k, "tied": d * (d + 1) // 2}[self.covariance_type]

    def bic(self, df: DataFrame) -> float:
        return -2 * self.score(df) + self.n_parameters() * np.log(df.count())

    def aic(self, df: DataFrame) -> float:
        return -2 * self.score(df) + 2 * self.n_parameters()

    def sample(self, spark, n: int = 1, seed: int = 0) -> DataFrame:
        """n rows: a component by its weight, then its mean plus Cholesky factor times normals."""
        edges, d = np.cumsum(self.weights), len(self.features)
        pick = "case " + " ".join(f"when u < {num(e)} then {i}" for i, e in enumerate(edges[:-1])) + f" else {len(edges) - 1} end" if len(edges) > 1 else "0"
        base = spark.range(n).select("id", F.rand(seed).alias("u"), *[F.randn(seed + 1 + j).alias(f"z_{j}") for j in range(d)]).withColumn("component", F.expr(pick))
        low = [np.linalg.cholesky(s) for s in self.covariances]
        z = [f"z_{j}" for j in range(d)]
        return base.select("id", "component", *[F.expr("case " + " ".join(f"when component = {i} then {dot(z, low[i][j], self.means[i, j])}" for i in range(len(low))) + " end").alias(f) for j, f in enumerate(self.features)])


@dataclass
class Agglomerative:
    """Bottom-up clustering of points (id, features): all mutual nearest pairs of a round merge at once, which for
    these linkages gives the same tree as one closest pair after the other.  Equal points are merged before.  Up to max_rows
    clusters have a matrix of their distances with Lance-Williams updates; as long as there are more, a round finds the nearest
    of each from the points, block by block, and keeps no pairs (merging.merges).  Different points, merges and labels are
    arrays and lists on the driver."""

    features: list[str]
    n_clusters: int = 2
    linkage: str = "average"
    distance_metric: str = "euclidean"
    max_rows: int = 5000
    merges: list[tuple[int, int, float, int]] | None = None
    labels: dict[int, int] | None = None
    centers: dict[int, list[float]] | None = None

    def fit(self, df: DataFrame, key: str = "id") -> Agglomerative:
        if self.linkage not in ("single", "complete", "average", "ward"):
            raise ValueError(f"unknown linkage {self.linkage!r}")
        array_distance("x", "y", self.distance_metric)
        points = complete(df, self.features).select(F.col(key).cast("long").alias("i"), F.array(*[F.col(f).cast("double") for f in self.features]).alias("x"))
        # Equal points merge first, at distance 0, each with the least of them; pairs are those of different points.
        least = "x" if self.distance_metric in ("euclidean", "manhattan") else "i"
        alike = points.groupBy(least).agg(F.min("i").alias("first"), F.count("*").cast("double").alias("many"), F.first("x").alias("x_"), F.sort_array(F.collect_list("i")).alias("all"))
        alike = alike.select("first", "many", F.col("x_").alias("x"), "all").toArrow().sort_by("first")
        first, many = (alike.column(c).to_numpy() for c in ("first", "many"))
        x = alike.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(first), len(self.features))
        every, size = alike.column("all").combine_chunks().flatten().to_numpy(zero_copy_only=False), many.astype(int)
        tree = [(d, int(first[i]), int(first[j])) for d, i, j in merges(df.sparkSession, x, many, self.linkage, self.distance_metric, self.max_rows)]
        more = np.ones(len(every), bool)
        more[np.cumsum(size) - size] = False
        tree += [(0.0, i, j) for i, j in zip(np.repeat(first, size)[more].tolist(), every[more].tolist())]
        ids, at = np.unique(every, return_index=True)
        self._cut(sorted(tree), ids, x[np.repeat(np.arange(len(first)), size)[at]])
        return self

    def _cut(self, tree: list[tuple[float, int, int]], ids: np.ndarray, x: np.ndarray) -> None:
        """Merges by distance, new clusters numbered on from the last; labels after n - n_clusters of them."""
        n = left = len(ids)
        up, number, size, self.merges, self._ids = list(range(n)), list(range(n)), [1] * n, [], ids
        ends = (np.searchsorted(ids, np.array([e[k] for e in tree], np.int64)).tolist() for k in (1, 2))

        def root(v: int) -> int:
            while up[v] != v:
                up[v] = v = up[up[v]]
            return v

        cut = list(up) if left <= self.n_clusters else None
        for step, ((d, _, _), i, j) in enumerate(zip(tree, *ends)):
            a, b = root(i), root(j)
            self.merges.append((number[a], number[b], d, size[a] + size[b]))
            size[a], number[a] = size[a] + size[b], n + step
            left -= a != b
            up[b] = a
            if left == self.n_clusters and cut is None:
                cut = [root(v) for v in range(n)]
        cut = np.array([root(v) for v in range(n)] if cut is None else cut, np.int64)
        # Clusters are numbered by their least ids.
        _, least, own = np.unique(cut, return_index=True, return_inverse=True)
        label = np.argsort(np.argsort(least))[own] if n else own
        self.labels = dict(zip(ids.tolist(), label.tolist()))
        self.centers = {c: x[label == c].mean(0).tolist() for c in range(len(least))}

    def cophenetic_correlation(self, df: DataFrame, key: str = "id") -> float:
        """Correlation of the distances of all pairs with the heights at which they first share a cluster."""
        height = {step: d for step, (_, _, d, _) in enumerate(self.merges)}
        member, rows = {k: [i] for k, i in enumerate(self._ids.tolist())}, []
        for step, (a, b, _, _) in enumerate(self.merges):
            rows += [(step, i, side) for side, c in enumerate((a, b)) for i in member[c]]
            member[len(self._ids) + step] = member[a] + member[b]
        spark = df.sparkSession
        sides = spark.createDataFrame(rows, "step long, i long, side int")
        heights = spark.createDataFrame(list(height.items()), "step long, h double")
        meet = sides.where("side = 0").alias("l").join(sides.where("side = 1").alias("r"), "step").join(heights, "step").select(F.col("l.i").alias("i"), F.col("r.i").alias("j"), "h")
        points = complete(df, self.features).select(F.col(key).cast("long").alias("i"), F.array(*[F.col(f).cast("double") for f in self.features]).alias("x"))
        pairs = meet.join(points, "i").join(points.select(F.col("i").alias("j"), F.col("x").alias("y")), "j")
        return metrics.first(pairs.agg(F.corr(F.expr(array_distance("x", "y", self.distance_metric)), F.col("h"))))

    def get_linkage_matrix(self) -> np.ndarray:
        return np.array(self.merges, float)

    def fit_predict(self, df: DataFrame, key: str = "id") -> DataFrame:
        self.fit(df, key)
        own = pa.table({"id": pa.array(self.labels.keys(), pa.int64()), "cluster": pa.array(self.labels.values(), pa.int32())})
        own = df.sparkSession.createDataFrame(own).withColumnRenamed("id", key)
        return df.join(F.broadcast(own), key)

    def predict(self, df: DataFrame) -> DataFrame:
        """Nearest center of the training clusters."""
        c = [self.centers[k] for k in sorted(self.centers)]
        return df.withColumn("cluster", F.expr(f"cast({argmin([squared_distance(self.features, x) for x in c])} as int)"))


@dataclass
class NaiveBayes:
    features: list[str]
    label: str = "label"
    variant: str = "gaussian"
    equal_priors: bool = False
    classes: list | None = None
    priors: np.ndarray | None = None
    means: np.ndarray | None = None
    variances: np.ndarray | None = None

    def fit(self, df: DataFrame) -> NaiveBayes:
        """One grouped aggregate: means and population variances + 1e-9, or (count + 1) / (total + features)."""
        if self.variant not in ("gaussian", "multinomial"):
            raise ValueError(f"unknown variant {self.variant!r}")
        gauss = self.variant == "gaussian"
        agg = [fn(f) for f in self.features for fn in ((F.avg, F.var_pop) if gauss else (F.sum,))]
        rows = complete(df, self.features).groupBy(self.label).agg(F.count("*").alias("n"), *agg).orderBy(self.label).collect()
        self.classes = [r[0] for r in rows]
        n = np.array([r[1] for r in rows], float)
        self.priors = np.full(len(n), 1 / len(n)) if self.equal_priors else n / n.sum()
        values = np.array([r[2:] for r in rows], float)
        if gauss:
            self.means, self.variances = values[:, 0::2], values[:, 1::2] + 1e-9
        else:
            self.means = (values + 1) / (values.sum(1, keepdims=True) + len(self.features))
        return self

    def _log_posteriors(self) -> list[str]:
        out = []
        for i, p in enumerate(self.priors):
            if self.variant == "gaussian":
                c = np.log(p) - 0.5 * np.log(2 * np.pi * self.variances[i]).sum()
                out.append(f"({num(c)} - " + " - ".join(f"({f} - {num(m)}) * ({f} - {num(m)}) / {num(2 * v)}" for f, m, v in zip(self.features, self.means[i], self.variances[i])) + ")")
            else:
                out.append(f"({dot(self.features, np.log(self.means[i] + 1e-9), np.log(p))})")
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        labels = ", ".join(repr(c) if isinstance(c, str) else str(c) for c in self.classes)
        return df.withColumn("prediction", F.expr(f"element_at(array({labels}), cast({argmax(self._log_posteriors())} + 1 as int))"))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        names = [f"p_{c}" for c in self.classes]
        q = [f"`{n}`" for n in names]
        out = df.withColumns({n: F.expr(e) for n, e in zip(names, self._log_posteriors())}).withColumn("lse_", F.expr(lse(q)))
        return out.withColumns({n: F.expr(f"exp({c} - lse_)") for n, c in zip(names, q)}).drop("lse_")

    def score(self, df: DataFrame) -> float | None:
        return metrics.accuracy(self.predict(df), self.label)


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of x and y, each sum over the features in order."""
    if metric == "cosine":
        return 1 - x @ y.T / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None] + 1e-10)
    d = np.zeros((len(x), len(y)))
    for f in range(x.shape[1]):
        gap = x[:, f, None] - y[None, :, f]
        d += gap * gap if metric == "euclidean" else np.abs(gap)
    return np.sqrt(d) if metric == "euclidean" else d


def _nearest(k: int, metric: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The k nearest training rows of the block for each of its queries."""
        own, other = rows[rows["query"]], rows[~rows["query"]].sort_values("key")
        found = []
        if len(own) and len(other):
            y = np.stack(other["x"].to_numpy())
            for lo in range(0, len(own), 256):
                x = np.stack(own["x"].to_numpy()[lo : lo + 256])
                d = distances(x, y, metric)
                limit = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                row, col = np.nonzero(d <= limit[:, None])
                order = np.lexsort((col, d[row, col], row))
                row, col = row[order], col[order]
                first = np.searchsorted(row, np.arange(len(x)))
                keep = np.arange(len(row)) - first[row] < k
                row, col = row[keep], col[keep]
                found.append(pd.DataFrame({"key": own["key"].to_numpy()[lo + row], "tid": other["key"].to_numpy()[col], "tlabel": other["tlabel"].to_numpy()[col], "distance": d[row, col]}))
        return pd.concat(found) if found else pd.DataFrame({"key": own["key"][:0], "tid": other["key"][:0], "tlabel": other["tlabel"][:0], "distance": np.zeros(0)})

    return run


@dataclass
class NearestNeighbors:
    """Exact k nearest neighbours of queries, block by block."""

    features: list[str]
    label: str = "label"
    key: str = "id"
    k: int = 5
    distance_metric: str = "euclidean"
    task: str = "classification"
    weights: str = "uniform"
    block: int = 4096
    train: DataFrame | None = None

    def fit(self, df: DataFrame) -> NearestNeighbors:
        array_distance("x", "y", self.distance_metric)
        self.train = complete(df, self.features).select(F.col(self.key).alias("tid"), F.array(*[F.col(f).cast("double") for f in self.features]).alias("y_"), F.col(self.label).alias("tlabel"))
        return self

    def neighbors(self, df: DataFrame) -> DataFrame:
        """(key, tid, tlabel, distance, rank) of the k nearest, ties by training key.

        Training rows stand in boxes (regions.Regions).  A query meets the rows of its own box; the distance of the k-th
        of them tells which other boxes can hold nearer ones, and it visits only those.  By cosine, or where queries
        would visit most boxes (in many dimensions), blocks of queries meet blocks of training rows, each pair of them a
        task that keeps k rows a query; a row goes to as many tasks as the other side has blocks.
        """
        label = self.train.schema["tlabel"].dataType.simpleString()
        q = df.select(F.col(self.key).alias("key"), F.array(*[F.col(f).cast("double") for f in self.features]).alias("x"), F.lit(None).cast(label).alias("tlabel"))
        t = self.train.select(F.col("tid").alias("key"), F.col("y_").alias("x"), "tlabel")
        many_q, many_t = q.count(), t.count()
        if many_t > self.block and many_q and self.distance_metric in ("euclidean", "manhattan"):
            found = self._by_regions(q, t, many_q, many_t)
            if found is not None:
                return found.withColumnRenamed("key", self.key)
        n_q, n_t = max(1, -(-many_q // self.block)), max(1, -(-many_t // self.block))
        deal = lambda rows, own, n, other, m, query: rows.withColumn(own, F.pmod(F.xxhash64("key", F.lit(7)), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("query", F.lit(query))
        both = deal(q, "a", n_q, "b", n_t, True).unionByName(deal(t, "b", n_t, "a", n_q, False))
        kinds = q.schema["key"].dataType.simpleString(), t.schema["key"].dataType.simpleString()
        found = both.groupBy("a", "b").applyInPandas(_nearest(self.k, self.distance_metric), f"key {kinds[0]}, tid {kinds[1]}, tlabel {label}, distance double")
        w = Window.partitionBy("key").orderBy("distance", "tid")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k).withColumnRenamed("key", self.key)

    def _by_regions(self, q: DataFrame, t: DataFrame, many_q: int, many_t: int) -> DataFrame | None:
        """(key, tid, tlabel, distance, rank), or None where the visits cost more than all pairs of blocks."""
        key, tid, label = (d.schema[c].dataType.simpleString() for d, c in ((q, "key"), (t, "key"), (t, "tlabel")))
        if key != tid:
            return None
        regions = Regions(t, many_t, max(min(REGION, self.block), 8 * self.k))
        train = written(regions.placed(t))
        home = regions.placed(q.drop("tlabel"))
        first = written(_met(home, train, _home(self.k, self.distance_metric, regions), f"key {key}, tid {tid}, tlabel {label}, distance double, rank int, open boolean, cell int, x array<double>"))
        names = ["key", "tid", "tlabel", "distance"]
        near, visits = first.where("cell < 0"), first.where("cell >= 0")
        n = visits.count()
        if n > many_q * max(4.0, many_t / self.block):
            removed(first, train)
            return None
        done = near.where("not open").select(*names, "rank")
        if not n:
            return done
        more = _met(visits.select("key", "x", F.col("distance").alias("bound"), "cell"), train, _visit(self.k, self.distance_metric), f"key {key}, tid {tid}, tlabel {label}, distance double")
        w = Window.partitionBy("key").orderBy("distance", "tid")
        both = near.where("open").select(*names).unionByName(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)
        return done.unionByName(both)

    def _votes(self, df: DataFrame) -> DataFrame:
        weight = F.lit(1.0) if self.weights == "uniform" else 1 / (F.col("distance") + 1e-10)
        return self.neighbors(df).groupBy(self.key, "tlabel").agg(F.sum(weight).alias("votes"))

    def predict(self, df: DataFrame) -> DataFrame:
        if self.task == "regression":
            found = self.neighbors(df).groupBy(self.key).agg(F.avg("tlabel").alias("prediction"))
        else:
            w = Window.partitionBy(self.key).orderBy(F.desc("votes"), "tlabel")
            found = self._votes(df).withColumn("r", F.row_number().over(w)).where("r = 1").select(self.key, F.col("tlabel").alias("prediction"))
        return df.join(found, self.key)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """(key, class, probability) of every class among the neighbours; shares of their number."""
        w = Window.partitionBy(self.key)
        return self._votes(df).select(self.key, F.col("tlabel").alias("class"), (F.col("votes") / F.sum("votes").over(w)).alias("probability"))

    def score(self, df: DataFrame) -> float | None:
        return (metrics.r2 if self.task == "regression" else metrics.accuracy)(self.predict(df), self.label)
