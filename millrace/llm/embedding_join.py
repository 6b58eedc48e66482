"""Near-duplicate vectors: an exact metric range join over cells around pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, sampled, table, written

#: Least cosine of a link.
COSINE = 0.9
#: Pivots for each dimension: those least by a hash of the id, so a bounded sample that only steers the work.
PIVOTS = 8
#: Bytes of vectors in a block; a cell with more is joined block by block.
BLOCK_BYTES = 64 << 20
#: Rounding that bounds and single-precision products may have.
SLACK = 1e-5


def unit(rows) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Unit vectors in double precision; None for those that link with nothing."""
    out = []
    for r in rows:
        v = None if r is None else np.asarray(r, np.float64)  # None components become nan
        if v is not None:
            with np.errstate(over="ignore", invalid="ignore"):
                v = v / most if (most := np.abs(v).max(initial=0.0)) > 0 and np.isfinite(v).all() else None
        out.append(None if v is None else v / np.sqrt((v * v).sum()))
    return out, np.array([v is not None for v in out], bool)


def cells(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each vector (the first on a tie), and the cells that it must be copied to.

    A vector y in the cell of pivot j is no farther from j than from i.  If |x - y| <= reach, then by
    the triangle inequality d(x, j) <= d(x, i) + 2 reach for the pivot i nearest to x; in Euclidean
    space also (d(x, j)^2 - d(x, i)^2) / (2 d(i, j)) <= reach, as y lies beyond the plane between i and
    j.  Cells that fail either need no copy.
    """
    d2 = np.maximum(2 - 2 * x @ pivots.T, 0)
    home = d2.argmin(1)
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    d = np.sqrt(d2)
    own, gap = np.arange(len(x)), between[home]
    near = d - d[own, home][:, None] <= 2 * reach + SLACK
    near &= d2 - d2[own, home][:, None] <= 2 * gap * (reach + SLACK) + SLACK
    near[own, home] = False
    return home, near


def _place(pivots: dict[int, np.ndarray], reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, _ = unit(batch.column("embedding").to_pylist())
            size = np.array([-1 if v is None else len(v) for v in vectors])
            ids, n = batch.column("rep").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
            for dim in np.unique(size[size >= 0]).tolist():
                rows = np.flatnonzero(size == dim)
                for lo in range(0, len(rows), 2048):
                    at = rows[lo : lo + 2048]
                    x = np.stack([vectors[i] for i in at])
                    home, near = cells(x, pivots[dim], reach) if dim in pivots else (np.zeros(len(at), int), np.zeros((len(at), 1), bool))
                    row, cell = np.nonzero(near)
                    row, cell, own = np.concatenate([np.arange(len(at)), row]), np.concatenate([home, cell]), np.arange(len(at) + len(row)) < len(at)
                    raw = [x[i].tobytes() for i in range(len(at))]
                    yield pa.record_batch([pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(own), pa.array(ids[at][row]), pa.array(n[at][row]), pa.array([raw[i] for i in row], pa.binary())], names=["dim", "cell", "own", "rep", "n", "x"])

    return run


def _join(cosine: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links of the block's own vectors with all of its other side: weighted count of each, and links
        that join the same vectors, no more of them than vectors."""
        own = np.flatnonzero(rows["left"].to_numpy() & rows["own"].to_numpy())
        other = np.flatnonzero(rows["right"].to_numpy())
        ids, n = rows["rep"].to_numpy(), rows["n"].to_numpy()
        x = np.frombuffer(b"".join(rows["x"]), np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
        single = x.astype(np.float32)
        counts, parent, links = np.zeros(len(rows), np.int64), np.arange(len(rows)), []

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for a in range(0, len(own), 512):
            left = own[a : a + 512]
            for b in range(0, len(other), 4096):
                right = other[b : b + 4096]
                close = single[left] @ single[right].T >= cosine - SLACK
                for i in np.flatnonzero(close.any(1)):
                    hits = right[close[i]]
                    hits = hits[x[hits] @ x[left[i]] >= cosine]
                    hits = hits[ids[hits] != ids[left[i]]]
                    if not len(hits):
                        continue
                    counts[left[i]] += n[hits].sum()
                    for h in np.unique(parent[hits]):
                        u, v = root(left[i]), root(h)
                        if u != v:
                            parent[max(u, v)] = min(u, v)
                            links.append((ids[u], ids[v]))
                    parent[hits] = parent[left[i]] = root(left[i])
        linked = own[counts[own] > 0]
        out = pd.DataFrame({"rep": np.concatenate([ids[linked], np.array([u for u, _ in links], np.int64)]), "other": pd.array([None] * len(linked) + [v for _, v in links], "Int64"), "n": np.concatenate([counts[linked], np.zeros(len(links), np.int64)])})
        return out

    return run


def link(vectors: DataFrame, cosine: float = COSINE, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding), extra columns ignored.

    Two rows link if their cosine, in double precision, is at least `cosine`.  A null or zero vector,
    one with null or non-finite components, one of another length, or a row without vec_id links with
    nothing.  Equal vectors are joined once and counted by their number; rows with the same vec_id count
    as rows of their own.  Each vector is in the cell of its nearest pivot and copied to those where a
    neighbour may be (cells()), so all links of a vector are found in its own cell, and cells are joined
    on their own.  A cell over BLOCK_BYTES is joined by pairs of blocks.  component_id is the smallest
    vec_id reachable over links, which are passed on as one spanning forest for each block, not as pairs.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0 and at most 1")
    spark, reach = vectors.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.exists("embedding", lambda v: v != 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fit = F.coalesce(fit, F.lit(False))
    groups = written(rows.where(fit).withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0))).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    sizes = groups.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()
    chosen: dict[int, np.ndarray] = {}
    for r in sizes:
        own = groups.where(F.size("embedding") == r["dim"])
        found = sampled(own, pivots, r["n"], "rep").select("embedding").collect() or own.select("embedding").limit(1).collect()
        chosen[r["dim"]] = np.stack(unit([x[0] for x in found])[0])
    placed = written(groups.mapInArrow(_place(chosen, reach), "dim int, cell int, own boolean, rep long, n long, x binary"))
    # Blocks of a cell: with b blocks, a row is on the left of the pairs (i, *) and on the right of (*, i).
    per_cell = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") * F.col("dim") * 8 / BLOCK_BYTES).cast("int").alias("b"))
    cut = placed.join(F.broadcast(per_cell), ["dim", "cell"]).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("b")).cast("int"))
    left = cut.where("own").withColumn("j", F.explode(F.expr("sequence(0, b - 1)"))).withColumn("left", F.lit(True)).withColumn("right", F.col("i") == F.col("j"))
    right = cut.withColumn("j", F.col("i")).withColumn("i", F.explode(F.expr("sequence(0, b - 1)"))).where("not (own and i = j)").withColumn("left", F.lit(False)).withColumn("right", F.lit(True))
    both = left.select("dim", "cell", "i", "j", "left", "right", "own", "rep", "n", "x").unionByName(right.select("dim", "cell", "i", "j", "left", "right", "own", "rep", "n", "x"))
    found = written(both.groupBy("dim", "cell", "i", "j").applyInPandas(_join(cosine), "rep long, other long, n long"))
    joined = components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    counts = found.where("other is null").groupBy("rep").agg(F.sum("n").alias("others"))
    reps = groups.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = rows.where(fit).withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0))).join(reps, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_embeddings": op1_embeddings}
ORACLE = {
    "op1_embeddings": """
with recursive v as (select vec_id, [cast(x as double) for x in embedding] as e from embeddings),
u as (select vec_id, e, sqrt(list_dot_product(e, e)) as len from v),
p as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) >= 0.9 * a.len * b.len),
c as (select vec_id as node, vec_id as reach from v union select c.node, p.b from c join p on c.reach = p.a),
m as (select node, min(reach) as component_id from c group by node)
select v.vec_id, coalesce(k.n, 0) as n_links, m.component_id, v.vec_id = m.component_id as kept
from v left join (select a, count(*) as n from p group by a) k on k.a = v.vec_id join m on m.node = v.vec_id""",
}
