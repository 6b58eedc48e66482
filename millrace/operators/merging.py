"""Bottom-up merges of clusters, all mutual nearest pairs of a round at once: in a matrix of all pairs of clusters, and before,
while they are too many for one, from their points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .factors import _boxes

#: Clusters whose nearest are looked for together, and distances that a task holds at once.
OWN, HELD = 256, 1 << 18


def apart(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of x and y, which are broadcast; each sum over the features in order, as in array_distance."""
    if metric == "cosine":
        dot = lambda a, b: sum((a[..., f] * b[..., f] for f in range(a.shape[-1])), np.zeros(()))
        return 1 - dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)) + 1e-10)
    d = np.zeros(())
    for f in range(x.shape[-1]):
        gap = x[..., f] - y[..., f]
        d = d + (gap * gap if metric == "euclidean" else np.abs(gap))
    return np.sqrt(d) if metric == "euclidean" else d


class Clusters:
    """Clusters 0, 1, ... of points x with weights, in the order of their least points; label is the cluster of each point."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, label: np.ndarray, linkage: str, metric: str) -> None:
        order = np.argsort(label, kind="stable")
        self.x, self.weight, self.linkage, self.metric = x[order], weight[order], linkage, metric
        self.many = np.bincount(label)
        self.start = np.cumsum(self.many) - self.many
        self.total = np.add.reduceat(self.weight, self.start)
        self.center = np.add.reduceat(self.x * self.weight[:, None], self.start) / self.total[:, None]
        alone = self.many == 1
        self.center[alone] = self.x[self.start[alone]]
        self.by_center = linkage == "ward" and metric == "euclidean"
        # No cluster is nearer than its center, by single linkage than that less both radii; otherwise nothing is known.
        self.bounded = metric != "cosine" and (linkage != "ward" or self.by_center) and bool(np.isfinite(self.x).all())
        self.radius = np.zeros(len(self.many))
        if self.bounded and linkage == "single":
            self.radius = np.maximum.reduceat(apart(self.x, np.repeat(self.center, self.many, 0), metric), self.start)
        self.within = np.zeros(len(self.many))
        if linkage == "ward" and not self.by_center:
            for c in np.flatnonzero(~alone):
                self.within[c] = self._sum(c, c) / (2 * self.total[c] ** 2)

    def __len__(self) -> int:
        return len(self.many)

    def _points(self, c: int) -> slice:
        return slice(self.start[c], self.start[c] + self.many[c])

    def _sum(self, a: int, b: int) -> float:
        """The least, greatest or summed distance (its square for ward) of the points of a and b, a part at a time."""
        rows, cols, out = self._points(a), self._points(b), []
        step = max(1, HELD // int(self.many[b]))
        for lo in range(rows.start, rows.stop, step):
            part = slice(lo, min(lo + step, rows.stop))
            d = apart(self.x[part, None], self.x[None, cols], self.metric)
            if self.linkage in ("single", "complete"):
                out.append(d.min() if self.linkage == "single" else d.max())
                continue
            d = d * d if self.linkage == "ward" else d
            out.append(float((d * self.weight[cols]).sum(1) @ self.weight[part]))
        return min(out) if self.linkage == "single" else max(out) if self.linkage == "complete" else sum(out)

    def _ward(self, d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = self.total[a], self.total[b]
        return d * np.sqrt(2 * n * m / (n + m))

    def _finished(self, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of clusters by the sums over their points."""
        if self.linkage == "average":
            return s / (self.total[a] * self.total[b])
        if self.linkage == "ward":
            return self._ward(np.sqrt(np.maximum(s / (self.total[a] * self.total[b]) - self.within[a] - self.within[b], 0)), a, b)
        return s

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of clusters a[k] and b[k], the same either way round."""
        a, b = np.minimum(a, b), np.maximum(a, b)
        if self.by_center:
            return self._ward(apart(self.center[a], self.center[b], self.metric), a, b)
        out = np.empty(len(a))
        size = self.many[a] * self.many[b]
        one = size == 1
        d = apart(self.x[self.start[a[one]]], self.x[self.start[b[one]]], self.metric)
        out[one] = self._ward(d, a[one], b[one]) if self.linkage == "ward" else d
        large = np.flatnonzero(size > HELD)
        if len(large):
            out[large] = self._finished(np.array([self._sum(int(i), int(j)) for i, j in zip(a[large], b[large])]), a[large], b[large])
        some = np.flatnonzero((size > 1) & (size <= HELD))
        upto = np.cumsum(size[some])
        for at in np.split(some, np.searchsorted(upto, np.arange(HELD, upto[-1] if len(upto) else 0, HELD))):
            if not len(at):
                continue
            n = size[at]
            first = np.cumsum(n) - n
            k = np.arange(n.sum()) - np.repeat(first, n)
            wide = np.repeat(self.many[b[at]], n)
            i, j = np.repeat(self.start[a[at]], n) + k // wide, np.repeat(self.start[b[at]], n) + k % wide
            d = apart(self.x[i], self.x[j], self.metric)
            if self.linkage in ("single", "complete"):
                out[at] = (np.minimum if self.linkage == "single" else np.maximum).reduceat(d, first)
                continue
            d = d * d if self.linkage == "ward" else d
            out[at] = self._finished(np.add.reduceat(d * self.weight[i] * self.weight[j], first), a[at], b[at])
        return out

    def nearest(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cluster of each of own, the first of equally near ones, and its distance.

        Of clusters whose bounds are least some are worked out; only those that can be as near are besides.
        """
        every = np.arange(len(self))
        bound = lambda a, b: apart(self.center[a][:, None], self.center[b][None], self.metric) - self.radius[a][:, None] - self.radius[b][None]
        if self.bounded:
            low, high = self.center[own].min(0), self.center[own].max(0)
            gap = np.maximum(0, np.maximum(low - self.center, self.center - high))
            far = apart(gap, np.zeros((1, gap.shape[1])), self.metric) - self.radius - self.radius[own].max()
            some = min(len(every), 2 * len(own) + 16)
            close = np.argpartition(far, some - 1)[:some]
            b = bound(own, close)
            b[own[:, None] == close[None]] = np.inf
            k = min(3, some - 1)
            pick = np.argpartition(b, k - 1, axis=1)[:, :k]
            reach = self.between(np.repeat(own, k), close[pick].ravel()).reshape(-1, k).min(1)
            reach = reach * (1 + 1e-9) + 1e-12 * np.abs(self.center).max()  # bounds are rounded, too
            every = np.flatnonzero(far <= reach.max())
        near, least = np.full(len(own), -1), np.full(len(own), np.inf)
        step = max(1, HELD // max(1, len(every)))
        for lo in range(0, len(own), step):
            mine = own[lo : lo + step]
            met = mine[:, None] != every[None]
            if self.bounded:
                met &= bound(mine, every) <= reach[lo : lo + step, None]
            row, col = np.nonzero(met)
            d = self.between(mine[row], every[col])
            d[np.isnan(d)] = np.inf
            order = np.lexsort((every[col], d, row))
            first = order[np.searchsorted(row[order], np.arange(len(mine)))]
            near[lo : lo + step], least[lo : lo + step] = every[col[first]], d[first]
        return near, least

    def row(self, a: int) -> np.ndarray:
        """Distances of cluster a and each after it."""
        after = np.arange(a + 1, len(self))
        if self.by_center or not len(after):
            return self.between(np.full(len(after), a), after)
        begin = self.start[a + 1]
        y, w, at = self.x[begin:], self.weight[begin:], self.start[a + 1 :] - begin
        rows, out = self._points(a), None
        step = max(1, HELD // len(y))
        for lo in range(rows.start, rows.stop, step):
            part = slice(lo, min(lo + step, rows.stop))
            d = apart(self.x[part, None], y[None], self.metric)
            if self.linkage in ("single", "complete"):
                best = np.minimum if self.linkage == "single" else np.maximum
                s = best.reduce(best.reduceat(d, at, axis=1))
                out = s if out is None else best(out, s)
                continue
            d = d * d if self.linkage == "ward" else d
            s = self.weight[part] @ np.add.reduceat(d * w, at, axis=1)
            out = s if out is None else out + s
        out = self._finished(out, np.full(len(after), a), after)
        if self.many[a] == 1:  # of single points the distance itself, not divided by weights again
            one = self.many[after] == 1
            d = apart(self.x[self.start[a]][None], y[at[one]], self.metric)
            out[one] = self._ward(d, np.full(len(d), a), after[one]) if self.linkage == "ward" else d
        return out


def mutual(near: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The first of each pair of clusters that are nearest to each other; there is one unless distances are rounded."""
    at = np.arange(len(near))
    found = np.flatnonzero((near[near] == at) & (at < near))
    return found if len(found) else np.array([int(np.argmin(d))])


def _closest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the place of the least value beside the diagonal, the first of equal ones, and the value; none is greater
    than one that is not a number."""
    near = np.empty(len(d), np.int64)
    for lo in range(0, len(d), 256):
        part = d[lo : lo + 256].copy()
        part[np.isnan(part)] = np.inf
        own = np.arange(lo, lo + len(part))
        part[own - lo, own] = np.inf
        near[own] = part.argmin(1)
        for i in own[np.isinf(part.min(1))]:
            order = np.lexsort((np.arange(len(d)), d[i], np.isnan(d[i])))
            near[i] = order[order != i][0]
    return near, d[np.arange(len(d)), near]


def _rows_merged(d: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray, own: np.ndarray, linkage: str) -> np.ndarray:
    """d with rows i in place of rows i and j: Lance-Williams, for clusters of n points and columns of m."""
    a, b = d[i], d[j]
    x, y = n[i][:, None], n[j][:, None]
    if linkage == "ward":
        d = np.sqrt(d * d)
        of = lambda c, z: ((z + m) * (c * c) - m * (own * own)[:, None] / 2) / ((x + y) + m)
        d[i] = np.sqrt(of(a, x) + of(b, y))
    else:
        d[i] = np.minimum(a, b) if linkage == "single" else np.maximum(a, b) if linkage == "complete" else x / (x + y) * a + y / (x + y) * b
    return np.delete(d, j, 0)


def merged(d: np.ndarray, size: np.ndarray, linkage: str) -> list[tuple[float, int, int]]:
    """(distance, first, second) of all merges of clusters of these sizes at distances d; the merged cluster keeps the first's number."""
    name, out = np.arange(len(d)), []
    with np.errstate(invalid="ignore"):
        while len(name) > 1:
            near, least = _closest(d)
            i = mutual(near, least)
            j, own = near[i], least[i]
            i, j = np.minimum(i, j), np.maximum(i, j)
            out += zip(own.tolist(), name[i].tolist(), name[j].tolist())
            # Distances are reduced side by side: first the rows, then the columns.
            d = _rows_merged(d, i, j, size, size, own, linkage)
            total = size.copy()
            total[i] += size[j]
            total = np.delete(total, j)
            d = np.ascontiguousarray(_rows_merged(d.T, i, j, size, total, own, linkage).T)
            name, size = np.delete(name, j), total
    return out


def _jobs(spark: SparkSession, n: int):
    return spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism)))


def nearest_of_all(spark: SparkSession, clusters: Clusters) -> tuple[np.ndarray, np.ndarray]:
    """Clusters.nearest() of all, block by block."""
    blocks = _boxes(clusters.center, OWN) if clusters.bounded else np.array_split(np.arange(len(clusters)), -(-len(clusters) // OWN))
    shared = spark.sparkContext.broadcast((clusters, blocks))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, blocks = shared.value
        for part in parts:
            for n in part.column("id").to_pylist():
                near, d = own.nearest(blocks[n])
                yield pa.record_batch([pa.array(blocks[n]), pa.array(near), pa.array(d)], names=["i", "j", "d"])

    found = _jobs(spark, len(blocks)).mapInArrow(run, "i long, j long, d double").toArrow()
    shared.destroy()
    i = found.column("i").to_numpy()
    near, d = np.empty(len(i), np.int64), np.empty(len(i))
    near[i], d[i] = found.column("j").to_numpy(), found.column("d").to_numpy()
    return near, d


def by_matrix(spark: SparkSession, clusters: Clusters) -> list[tuple[float, int, int]]:
    """merged() of the clusters: the rows of the matrix by blocks, the rounds in one task, which holds it."""
    n, size, linkage = len(clusters), clusters.total, clusters.linkage
    jobs = _jobs(spark, min(n, 64))
    many, shared = min(n, 64), spark.sparkContext.broadcast(clusters)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first in part.column("id").to_pylist():
                for a in range(first, n, many):
                    yield pa.record_batch([pa.array([a], pa.int64()), pa.array([shared.value.row(a).tobytes()], pa.binary())], names=["i", "row"])

    def rounds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = np.zeros((n, n))
        for part in parts:
            for a, row in zip(part.column("i").to_pylist(), part.column("row")):
                d[a, a + 1 :] = d[a + 1 :, a] = np.frombuffer(row.as_buffer(), float)
        out = merged(d, size, linkage)
        yield pa.record_batch([pa.array([r[0] for r in out], pa.float64()), *(pa.array([r[k] for r in out], pa.int64()) for k in (1, 2))], names=["d", "i", "j"])

    found = jobs.mapInArrow(rows, "i long, row binary").repartition(1).mapInArrow(rounds, "d double, i long, j long").toArrow()
    shared.destroy()
    return list(zip(*(found.column(c).to_pylist() for c in ("d", "i", "j"))))


def merges(spark: SparkSession, x: np.ndarray, weight: np.ndarray, linkage: str, metric: str, kept: int) -> list[tuple[float, int, int]]:
    """(distance, first, second) of all merges of points x with weights, by their places; a merged cluster goes by its first.

    While there are more than `kept` clusters, nothing is kept of their pairs: a round finds each one's nearest from the points.
    """
    label, first, out = np.arange(len(x)), np.arange(len(x)), []
    clusters = Clusters(x, weight, label, linkage, metric) if len(x) else []
    while len(clusters) > max(kept, 1):
        near, d = nearest_of_all(spark, clusters)
        i = mutual(near, d)
        i, j, d = np.minimum(i, near[i]), np.maximum(i, near[i]), d[i]
        out += zip(d.tolist(), first[i].tolist(), first[j].tolist())
        to = np.arange(len(first))
        to[j] = i
        left = np.delete(np.arange(len(first)), j)
        label, first = np.searchsorted(left, to)[label], first[left]
        clusters = Clusters(x, weight, label, linkage, metric)
    if len(clusters) > 1:
        out += [(d, int(first[i]), int(first[j])) for d, i, j in by_matrix(spark, clusters)]
    return out
