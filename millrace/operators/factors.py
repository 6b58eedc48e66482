"""Implicit factorization by alternating least squares, and the best products of two sets of vectors, block by block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import array_dot, num
from ..functions.prepare import draw
from .loop import removed, written

#: Bytes of factors up to which the smaller side goes to the ratings by broadcast; beyond, both are dealt by key.
BROADCAST_BYTES = 32 << 20
#: Rows of a block of products: this many users at least where that gives each core work, up to 16 times as many, and up to 64 times as many items.
BLOCK = 2048
#: Users whose best items are looked for together, and items that they meet first.
NEAR, FIRST = 256, 128


def normal_vectors(key: str, d: int, seed: str, deviation: float) -> Column:
    """d normal draws of a row, from hashes of (seed, place, key)."""
    return F.array(*[F.expr(f"sqrt(-2 * ln(1 - {draw(key, f'{seed}:{j}:{key}')})) * cos(2 * pi() * {draw(key, f'{seed}:{j}:{key}2')}) * {num(deviation)}") for j in range(d)])


def _boxes(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of x, cut at medians of the widest column until `size` or fewer are together."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(np.sort(at))
            continue
        wide = x[at].max(0) - x[at].min(0)
        half = np.argpartition(x[at, int(wide.argmax())], len(at) // 2)
        todo += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
    return out


def _products(k: int, low: float | None, high: float | None):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The k best items of the block for each of its users, without the pairs given.

        Users whose vectors are near go together: a product is that of their middle plus what the rest of the user's vector
        can add at most.  The items come in the order of these bounds, until none left can be among a user's k best.
        """
        users, items, pairs = (rows[rows["kind"] == n] for n in range(3))
        items, found = items.sort_values("item"), []
        if len(users) and len(items):
            v, names = np.stack(items["x"].to_numpy()), items["item"].to_numpy()
            row_of = pd.Series(np.arange(len(users)), index=users["user"].to_numpy())
            pairs = pairs[pairs["user"].isin(row_of.index)]
            gone = np.concatenate(pairs["given"].to_list()) if len(pairs) else names[:0]
            r = np.repeat(row_of.reindex(pairs["user"].to_numpy()).to_numpy(), pairs["given"].map(len).to_numpy(int)) if len(pairs) else np.zeros(0)
            c = np.searchsorted(names, gone)
            known = c < len(names)
            known[known] = names[c[known]] == gone[known]
            given = np.sort(r[known].astype(np.int64) * len(names) + c[known])
            x, at = np.stack(users["x"].to_numpy()), min(k, len(v))
            norm = np.abs(x).sum(1) * np.abs(v).max()  # bounds are widened by more than what sums are rounded by
            # From the middle of the items on, a column that is the same in all of them adds nothing.
            middle = (v.min(0) + v.max(0)) / 2
            off = np.ascontiguousarray((v - middle).T)
            size, base = np.abs(off), x @ middle

            def products(own: np.ndarray, b: np.ndarray) -> np.ndarray:
                s = sum(x[own, f, None] * v[b, f] for f in range(x.shape[1]))
                if low is not None:
                    s = np.clip(s, low, high)
                place = own[:, None] * len(names) + b
                if len(given):
                    near = np.minimum(np.searchsorted(given, place), len(given) - 1)
                    s[given[near] == place] = -np.inf
                return s

            best_s, best_c = np.full((len(x), at), -np.inf), np.full((len(x), at), len(names), np.int64)

            def meet(own: np.ndarray, here: np.ndarray) -> None:
                for u in np.array_split(own, -(-len(own) * len(here) // (1 << 20))):
                    s = np.concatenate([best_s[u], products(u, here)], 1)
                    cc = np.concatenate([best_c[u], np.broadcast_to(here, (len(u), len(here)))], 1)
                    order = _first(s, cc, at)
                    best_s[u], best_c[u] = np.take_along_axis(s, order, 1), np.take_along_axis(cc, order, 1)

            for own in _boxes(x * size.max(1), NEAR):
                least, most = x[own].min(0), x[own].max(0)
                bound = np.nan_to_num((least + most) / 2 @ off + (most - least) / 2 @ size, nan=np.inf, posinf=np.inf)
                left, many = np.arange(len(names)), FIRST
                if low is not None:
                    # Products beyond the limit are equal, so the first of those items are the best: they come in order.
                    beyond = bound + np.nan_to_num((base[own] + 1e-12 * norm[own]).max(), nan=np.inf) >= high
                    full, left = left[beyond], left[~beyond]
                    while len(own) and len(full):
                        meet(own, full[:many])
                        full, many = full[many:], 2 * many
                        if len(full):
                            own = own[(best_s[own, -1] < high) | (best_c[own, -1] > full[0])]
                    many = FIRST
                while len(own) and len(left):
                    reach = base[own] + bound[left].max() + 1e-12 * norm[own]
                    if low is not None:
                        reach = np.clip(reach, low, high)
                    own = own[~((reach < best_s[own, -1]) | (reach == best_s[own, -1]) & (best_c[own, -1] < left.min()))]
                    if len(own):
                        # The items of the greatest bounds, and what is left after them.
                        many = min(many, len(left))
                        cut = np.argpartition(-bound[left], many - 1) if many < len(left) else np.arange(len(left))
                        meet(own, np.sort(left[cut[:many]]))
                        left, many = left[cut[many:]], 2 * many
            row, col = np.nonzero(best_s > -np.inf)
            found.append(pd.DataFrame({"user": users["user"].to_numpy()[row], "item": names[best_c[row, col]], "prediction": best_s[row, col]}))
        return pd.concat(found) if found else pd.DataFrame({"user": users["user"][:0], "item": items["item"][:0], "prediction": np.zeros(0)})

    return run


def _first(s: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Of each row the places of its k greatest s, equal ones by c."""
    limit = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(s >= limit)
    order = np.lexsort((c[row, col], -s[row, col], row))
    row, col = row[order], col[order]
    return col[np.arange(len(row)) - np.searchsorted(row, row) < k].reshape(len(s), k)


def best_products(users: DataFrame, items: DataFrame, k: int, without: DataFrame | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """(user, item, prediction, rank): of each user (user, x) the k items (item, x) of the greatest product of their vectors,
    within low and high, ties by item; not the pairs (user, item) of without.

    Blocks of users meet blocks of items, each pair of them a task that keeps k items a user; only those are ranked.  A
    given pair goes to the one task that it is in.  Keys are unique and not null.
    """
    total, cores = users.count(), users.sparkSession.sparkContext.defaultParallelism
    n_u, n_i = max(1, -(-total // (16 * BLOCK)), min(2 * cores, -(-total // BLOCK))), max(1, -(-items.count() // (64 * BLOCK)))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((users, "user"), (items, "item"))}
    at = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(n)).cast("int")
    none = lambda c: F.lit(None).cast(kinds[c])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    empty = F.lit(None).cast(f"array<{kinds['item']}>").alias("given")
    both = users.select(F.lit(0).alias("kind"), "user", none("item").alias("item"), "x", empty, at("user", n_u).alias("a"), every(n_i).alias("b"))
    both = both.unionByName(items.select(F.lit(1).alias("kind"), none("user").alias("user"), "item", "x", empty, at("item", n_i).alias("b"), every(n_u).alias("a")))
    if without is not None:
        # A user's pairs of a block are one row: millions of rows of two keys are slow to hand over.
        pairs = without.select(F.col("user").cast(kinds["user"]), F.col("item").cast(kinds["item"])).dropna()
        pairs = pairs.groupBy("user", at("item", n_i).alias("b")).agg(F.collect_list("item").alias("given"))
        both = both.unionByName(pairs.select(F.lit(2).alias("kind"), "user", none("item").alias("item"), F.lit(None).cast("array<double>").alias("x"), "given", at("user", n_u).alias("a"), "b"))
    found = both.groupBy("a", "b").applyInPandas(_products(k, low, high), f"user {kinds['user']}, item {kinds['item']}, prediction double")
    w = Window.partitionBy("user").orderBy(F.desc("prediction"), "item")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def packed(ratings: DataFrame, codes: DataFrame) -> DataFrame:
    """(user, items, ratings): the ratings (user, item, rating) of a user as arrays, of the items their codes (item, code), a
    few to ten thousand a row, so a user of many has several rows."""
    rows = ratings.join(F.broadcast(codes), "item").select("user", "code", F.col("rating").cast("double").alias("rating"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                user = batch.column("user").to_numpy(zero_copy_only=False)
                begin = np.concatenate([[0], np.flatnonzero(user[1:] != user[:-1]) + 1, [len(user)]]).astype(np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(begin), batch.column(c)) for c in ("code", "rating"))
                yield pa.record_batch([batch.column("user").take(pa.array(begin[:-1])), *lists], names=["user", "items", "ratings"])

    return rows.repartition("user").sortWithinPartitions("user").mapInArrow(run, f"user {ratings.schema['user'].dataType.simpleString()}, items array<int>, ratings array<double>")


def rating_sums(rows: DataFrame, users: DataFrame, bi: np.ndarray, v: np.ndarray, mean: float, low: float, high: float) -> DataFrame:
    """(user, bu, u, code, n, squares, se, g) of packed rows and users (user, bu, u): counts and sums of the errors, of their
    squares and of them times the other side's factors; a row of a user for each of its packed rows, and one of each item
    (no user) for each task.

    The items' biases and factors come to the tasks, where the errors are worked out once for both sides.
    """
    shared, d = rows.sparkSession.sparkContext.broadcast((bi, v)), v.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bi, v = shared.value
        count, total = np.zeros(len(bi), np.int64), np.zeros((d + 1, len(bi)))
        names, kind = ["user", "bu", "u", "code", "n", "squares", "se", "g"], None
        for batch in batches:
            if not batch.num_rows:
                continue
            many, user = batch.column("items").value_lengths().to_numpy(), batch.column("user")
            at, kind = batch.column("items").flatten().to_numpy(), user.type
            who, start = np.repeat(np.arange(len(many)), many), np.cumsum(many) - many
            bu, u = batch.column("bu").to_numpy(), batch.column("u").flatten().to_numpy().reshape(len(many), d)
            mine, other = u[who].T, v[at].T
            raw = mean + bu[who] + bi[at] + sum((mine[j] * other[j] for j in range(d)), np.zeros(()))
            e = batch.column("ratings").flatten().to_numpy() - np.minimum(np.maximum(raw, low), high)
            count += np.bincount(at, minlength=len(bi))
            for j in range(d + 1):
                total[j] += np.bincount(at, e * mine[j - 1] if j else e, len(bi))
            sums = lambda x: np.add.reduceat(x, start)
            g = np.stack([sums(e * other[j]) for j in range(d)], 1)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), d).cast(pa.list_(pa.float64())) for x in (u, g)]
            yield pa.record_batch([user, pa.array(bu), lists[0], pa.nulls(len(many), pa.int32()), pa.array(many.astype(np.int64)), pa.array(sums(e * e)), pa.array(sums(e)), lists[1]], names=names)
        seen = np.flatnonzero(count)
        for lo in range(0, len(seen), 10_000):
            own = seen[lo : lo + 10_000]
            none, g = (lambda t: pa.nulls(len(own), t)), np.ascontiguousarray(total[1:, own].T)  # noqa: E731, B023
            g = pa.FixedSizeListArray.from_arrays(pa.array(g.reshape(-1)), d).cast(pa.list_(pa.float64()))
            yield pa.record_batch([none(kind), none(pa.float64()), none(pa.list_(pa.float64())), pa.array(own.astype(np.int32)), pa.array(count[own]), none(pa.float64()), pa.array(total[0, own]), g], names=names)

    kind = users.schema["user"].dataType.simpleString()
    return rows.join(users, "user").select("user", "bu", "u", "items", "ratings").mapInArrow(run, f"user {kind}, bu double, u array<double>, code int, n long, squares double, se double, g array<double>")


def _solved(key: str, d: int, shared: np.ndarray):
    """Of each key: the solution of its normal equations, a batch at once."""
    left, right = np.array(list(combinations_with_replacement(range(d), 2))).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c, n: np.stack([batch.column(f"{c}{j}").to_numpy() for j in range(n)], 1)
            a = np.tile(shared, (batch.num_rows, 1, 1))
            own = get("a", len(left))
            a[:, left, right] += own
            off = left != right
            a[:, right[off], left[off]] += own[:, off]
            x = np.linalg.solve(a, get("b", d)[:, :, None])[:, :, 0]
            yield pa.record_batch([batch.column(key), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), d).cast(pa.list_(pa.float64()))], names=[key, "f"])

    return run


@dataclass
class ImplicitFactorization:
    """Strengths (user, item, rating) of implicit feedback as products of factors, by alternating least squares.

    A pair of positive strength r is a preference of 1 with confidence 1 + alpha r; every other pair is a preference of
    0 with confidence 1.  Strengths of a pair add up; null keys and strengths that are null, zero or less say nothing.
    A sweep solves each user's normal equations for fixed items, then each item's for fixed users: a join, sums of the
    products of factors over the pairs of a key, which are added map-side, one d x d Gram matrix of all rows of the
    fixed side in place of the pairs without strength, and solutions in Arrow batches.  Users start from the items' draws.
    """

    n_factors: int = 10
    regularization: float = 0.1
    alpha: float = 40.0
    n_epochs: int = 10
    init_std: float = 0.1
    seed: int = 0
    users: DataFrame | None = None  # user, f
    items: DataFrame | None = None  # item, f
    ratings: DataFrame | None = None
    losses: list[float] = field(default_factory=list)

    def _gram(self, side: DataFrame) -> np.ndarray:
        pairs = list(combinations_with_replacement(range(self.n_factors), 2))
        found = side.agg(*[F.sum(F.col("f")[j] * F.col("f")[k]) for j, k in pairs]).first()
        out = np.zeros((self.n_factors, self.n_factors))
        for (j, k), v in zip(pairs, found):
            out[j, k] = out[k, j] = v or 0.0
        return out

    def _beside(self, rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
        small = side.count() * (8 * self.n_factors + 64) <= BROADCAST_BYTES
        return rows.join(F.broadcast(side) if small else side, key)

    def _half(self, ratings: DataFrame, key: str, fixed: DataFrame, other: str, gram: np.ndarray) -> DataFrame:
        d = self.n_factors
        joined = self._beside(ratings, fixed, other).withColumn("w", self.alpha * F.col("rating"))
        sums = [F.sum(F.col("w") * F.col("f")[j] * F.col("f")[k]).alias(f"a{n}") for n, (j, k) in enumerate(combinations_with_replacement(range(d), 2))]
        sums += [F.sum((1 + F.col("w")) * F.col("f")[j]).alias(f"b{j}") for j in range(d)]
        shared = gram + self.regularization * np.eye(d)
        kind = ratings.schema[key].dataType.simpleString()
        return joined.groupBy(key).agg(*sums).mapInArrow(_solved(key, d, shared), f"`{key}` {kind}, f array<double>")

    def fit(self, df: DataFrame) -> ImplicitFactorization:
        pairs = df.select("user", "item", F.col("rating").cast("double").alias("rating")).dropna().where("rating > 0")
        # A user's pairs lie in one file, so the sums of a task leave a row a user.
        self.ratings = written(pairs.repartition("user").groupBy("user", "item").agg(F.sum("rating").alias("rating")))
        self.items, self.users, self.losses = written(self.ratings.select("item").distinct().select("item", normal_vectors("item", self.n_factors, str(self.seed), self.init_std).alias("f"))), None, []
        of_items = self._gram(self.items)
        for _ in range(self.n_epochs):
            old = self.users, self.items
            self.users = written(self._half(self.ratings, "user", self.items, "item", of_items))
            of_users = self._gram(self.users)
            self.items = written(self._half(self.ratings, "item", self.users, "user", of_users))
            of_items = self._gram(self.items)
            removed(*(t for t in old if t is not None))
            self.losses.append(self._loss(of_users, of_items))
        return self

    def _loss(self, of_users: np.ndarray, of_items: np.ndarray) -> float:
        """The weighted squared error of all pairs, those without strength by the trace of both Gram matrices, and the penalty."""
        seen = self._beside(self._beside(self.ratings, self.users.withColumnRenamed("f", "u"), "user"), self.items.withColumnRenamed("f", "v"), "item")
        x = array_dot("u", "v")
        observed = seen.select(F.expr(f"(1 + {num(self.alpha)} * rating) * pow(1 - ({x}), 2) - pow({x}, 2)").alias("e")).agg(F.sum("e")).first()[0] or 0.0
        return observed + float(np.trace(of_users @ of_items)) + self.regularization * float(np.trace(of_users) + np.trace(of_items))

    def predict(self, df: DataFrame) -> DataFrame:
        """df (user, item, ...) with prediction; null for a user or item without factors."""
        out = df.join(self.users.withColumnRenamed("f", "u"), "user", "left").join(self.items.withColumnRenamed("f", "v"), "item", "left")
        return out.withColumn("prediction", F.expr(array_dot("u", "v"))).drop("u", "v")

    def fold_in(self, df: DataFrame) -> DataFrame:
        """(user, f) of users with new strengths (user, item, rating), for the items as they are; unknown items say nothing."""
        pairs = df.select("user", "item", F.col("rating").cast("double").alias("rating")).dropna().where("rating > 0")
        pairs = pairs.groupBy("user", "item").agg(F.sum("rating").alias("rating"))
        return self._half(pairs, "user", self.items, "item", self._gram(self.items))

    def recommend(self, users: DataFrame, n: int = 10, exclude_rated: bool = True) -> DataFrame:
        """(user, item, prediction, rank) of the n best items of users with factors."""
        own = users.select("user").distinct().join(self.users, "user").withColumnRenamed("f", "x")
        rated = self.ratings.join(own.select("user"), "user", "left_semi") if exclude_rated else None
        return best_products(own, self.items.withColumnRenamed("f", "x"), n, rated)

    def mean_percentile_rank(self, df: DataFrame) -> float:
        """Of held-out strengths (user, item, rating): the mean place of the items among all of their user, weighted by strength;
        0 is the top, 0.5 is chance.  Users' items are counted in blocks by comparison with the held-out item's product."""
        held = df.join(self.users.withColumnRenamed("f", "u"), "user").join(self.items.withColumnRenamed("f", "v"), "item").select(F.monotonically_increasing_id().alias("row"), "u", "rating", F.expr(array_dot("u", "v")).alias("own"))
        held = written(held)
        total = self.items.count()
        parts = max(1, -(-total // BLOCK))
        blocks = self.items.withColumn("b", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")).groupBy("b").agg(F.collect_list("f").alias("fs"))
        dealt = held.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(blocks, "b")
        above = dealt.select("row", F.expr(f"size(filter(fs, v -> {array_dot('u', 'v')} > own))").alias("n")).groupBy("row").agg(F.sum("n").alias("n"))
        return held.join(above, "row").agg(F.sum(F.col("rating") * F.col("n") / max(total - 1, 1)) / F.sum("rating")).first()[0]

