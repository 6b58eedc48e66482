"""Hidden Markov models over sequences of any length: rows in place of arrays, by an associative scan of matrices."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import before, numbered
from .loop import removed, written
from .sequences import HiddenMarkov


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _times(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Products of the log matrices of two batches."""
    return _lse(m[:, :, :, None] + n[:, None, :, :], 2)


def _padded(lists: list) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in lists])
    out = np.zeros((len(lists), size.max(initial=0)), np.int64)
    for row, x in zip(out, lists):
        row[: len(x)] = x
    return out, size


class _Steps:
    """The parameters in logs; all chunks of a batch take a step at once."""

    def __init__(self, model: HiddenMarkov) -> None:
        self.pi, self.a, self.b, _ = model._logs()

    def reach(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Matrices of a step to symbols x; where a sequence starts, all states lead to its first one alike."""
        out = self.a[None] + self.b[:, x].T[:, None, :]
        out[starts] = (self.pi + self.b[:, x[starts]].T)[:, None, :]
        return out

    def product(self, codes: list, first: np.ndarray) -> np.ndarray:
        x, size = _padded(codes)
        k = len(self.pi)
        out = np.tile(np.where(np.eye(k) > 0, 0.0, -np.inf), (len(codes), 1, 1))
        for t in range(x.shape[1]):
            on = size > t
            out[on] = _times(out[on], self.reach(x[on, t], first[on] & (t == 0)))
        return out

    def counts(self, codes: list, first: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """[log likelihood of the sequences that start here, expected starts, steps, symbols], summed over the chunks, and
        the log likelihood that each chunk sees."""
        x, size = _padded(codes)
        (n, long), k, m = x.shape, len(self.pi), self.b.shape[1]
        ahead, at = np.empty((long + 1, n, k)), np.empty((long, n, k))
        ahead[0] = alpha
        for t in range(long):
            ahead[t + 1] = _lse(ahead[t][:, :, None] + self.reach(x[:, t], first & (t == 0)), 1)
        for t in range(long - 1, -1, -1):
            at[t] = beta
            if t + 1 < long:
                on = size > t + 1
                at[t, on] = _lse(self.a[None] + (self.b[:, x[on, t + 1]].T + at[t + 1, on])[:, None, :], 2)
        ll = _lse(ahead[1] + at[0], 1)
        steps, symbols, starts = np.zeros((k, k)), np.zeros((m, k)), np.zeros(k)
        for t in range(long):
            on = size > t
            here = np.exp(ahead[t + 1, on] + at[t, on] - ll[on, None])
            np.add.at(symbols, x[on, t], here)
            starts += here[first[on]].sum(0) if t == 0 else 0
            on &= ~(first & (t == 0))
            steps += np.exp(ahead[t, on][:, :, None] + self.a[None] + (self.b[:, x[on, t]].T + at[t, on])[:, None, :] - ll[on, None, None]).sum(0)
        return np.concatenate([[ll[first].sum()], starts, steps.ravel(), symbols.T[:, : m - 1].ravel()]), ll


@dataclass
class LongChains:
    """A HiddenMarkov model on rows (seq_id, order columns, symbol): a sequence may have any number of rows.

    A sequence is cut into chunks of `chunk` rows.  Each chunk's steps are multiplied to one matrix; `fan` matrices in a
    row give one of the next level, until a sequence has one.  On the way down each level gets what comes before and after
    it, at last the chunks, which then hold all that the expected counts need.  No row of a table has more than a chunk's
    symbols or fan matrices, and all chunks of a batch take a step at once.  Nulls in the order come first; a null
    or unknown symbol has probability eps; rows without seq_id are one sequence; order columns should tell rows apart.
    """

    model: HiddenMarkov
    order: list[str]
    key: str = "seq_id"
    symbol: str = "symbol"
    chunk: int = 1024
    fan: int = 256

    def chunks(self, rows: DataFrame) -> DataFrame:
        """(key, c, codes), written: the symbols' numbers, chunk by chunk."""
        code = F.coalesce(*[F.when(F.col(self.symbol) == s, i) for i, s in enumerate(self.model.symbols)], F.lit(len(self.model.symbols)))
        own = rows.select(self.key, *self.order, code.alias("code_"))
        at = written(numbered(own, [self.key, *self.order], "place_"))
        at = before(at.select(self.key, "code_", "place_"), self.key, "place_", {"n_": "1"})
        out = at.groupBy(self.key, F.expr(f"cast(n_ div {self.chunk} as long)").alias("c")).agg(F.expr("transform(array_sort(collect_list(struct(n_, code_))), x -> x.code_)").alias("codes"))
        return written(out)

    def _beside(self, chunks: DataFrame) -> DataFrame:
        """chunks with alpha and beta: the logs of what leads to a chunk, and of what follows it."""
        steps, key, k = _Steps(self.model), self.key, len(self.model.states)
        kind = chunks.schema[key].dataType.simpleString()

        def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    m = steps.product(part["codes"].tolist(), part["c"].to_numpy() == 0)
                    yield pd.DataFrame({key: part[key], "c": part["c"], "m": list(m.reshape(len(part), -1))})

        def together(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = []
                for own in part["own"]:
                    m = np.stack([o["m"] for o in own]).reshape(-1, k, k)
                    while len(m) > 1:  # neighbours first: products are associative
                        pairs = _times(m[0 : len(m) // 2 * 2 : 2], m[1::2])
                        m = np.concatenate([pairs, m[-1:]]) if len(m) % 2 else pairs
                    out.append(m[0].ravel())
                yield pd.DataFrame({key: part[key], "c": part["c"], "m": out})

        def down(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out: list[tuple] = []
                for name, own, alpha, beta in zip(part[key], part["own"], part["alpha"], part["beta"]):
                    m = np.stack([o["m"] for o in own]).reshape(-1, k, k)
                    al, be = [np.asarray(alpha, float)], [np.asarray(beta, float)]
                    for x in m[:-1]:
                        al.append(_lse(al[-1][:, None] + x, 0))
                    for x in m[:0:-1]:
                        be.append(_lse(x + be[-1][None], 1))
                    out += [(name, o["c"], x, y) for o, x, y in zip(own, al, be[::-1])]
                yield pd.DataFrame(out, columns=[key, "c", "alpha", "beta"])

        levels = [written(chunks.mapInPandas(products, f"`{key}` {kind}, c long, m array<double>"))]
        grouped = lambda level: level.groupBy(key, F.expr(f"c div {self.fan}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("c", "m"))).alias("own"))
        while (levels[-1].agg(F.max("c")).first()[0] or 0) > 0:
            up = grouped(levels[-1]).withColumnRenamed("up", "c")
            levels.append(written(up.mapInPandas(together, f"`{key}` {kind}, c long, m array<double>")))
        start = F.array(*[F.lit(0.0)], *[F.lit(float("-inf"))] * (k - 1))
        sides = levels[-1].select(key, "c", start.alias("alpha"), F.array(*[F.lit(0.0)] * k).alias("beta"))
        for level in levels[-2::-1]:
            over = sides.select(F.col(key).alias("key_"), F.col("c").alias("up_"), "alpha", "beta")
            both = grouped(level).join(over, F.col(key).eqNullSafe(F.col("key_")) & (F.col("up") == F.col("up_"))).select(key, "own", "alpha", "beta")
            sides = both.mapInPandas(down, f"`{key}` {kind}, c long, alpha array<double>, beta array<double>")
        sides = sides.select(F.col(key).alias("key_"), F.col("c").alias("c_"), "alpha", "beta")
        out = written(chunks.join(sides, F.col(key).eqNullSafe(F.col("key_")) & (F.col("c") == F.col("c_"))).drop("key_", "c_"))
        removed(*levels)
        return out

    def _counted(self, beside: DataFrame) -> DataFrame:
        """(counts) of each batch of chunks."""
        steps = _Steps(self.model)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    yield pd.DataFrame({"counts": [steps.counts(part["codes"].tolist(), part["c"].to_numpy() == 0, np.stack(part["alpha"]), np.stack(part["beta"]))[0]]})

        return beside.select("c", "codes", "alpha", "beta").mapInPandas(run, "counts array<double>")

    def score(self, rows: DataFrame) -> DataFrame:
        """(key, log_likelihood, perplexity) of each sequence."""
        steps, key = _Steps(self.model), self.key
        chunks = self.chunks(rows)
        kind = chunks.schema[key].dataType.simpleString()

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    ll = steps.counts(part["codes"].tolist(), part["c"].to_numpy() == 0, np.stack(part["alpha"]), np.stack(part["beta"]))[1]
                    yield pd.DataFrame({key: part[key], "c": part["c"], "ll": ll, "n": part["codes"].map(len)})

        found = self._beside(chunks).mapInPandas(run, f"`{key}` {kind}, c long, ll double, n long")
        found = found.groupBy(key).agg(F.max(F.when(F.col("c") == 0, F.col("ll"))).alias("log_likelihood"), F.sum("n").alias("n_"))
        return found.withColumn("perplexity", F.exp(-F.col("log_likelihood") / F.col("n_"))).drop("n_")

    def anomalies(self, rows: DataFrame, share: float = 0.05) -> DataFrame:
        """score() with is_anomaly: the perplexity is above the (1 - share) percentile of all sequences, by a mergeable summary."""
        found = written(self.score(rows))
        cut = found.agg(F.percentile_approx("perplexity", 1 - share, 100_000)).first()[0]
        return found.withColumn("is_anomaly", F.col("perplexity") > F.lit(cut))

    def fit(self, rows: DataFrame, n_iter: int = 100, tolerance: float = 1e-4) -> LongChains:
        """Baum-Welch, as HiddenMarkov.fit: the expected counts of all chunks, summed by Spark, give the next parameters."""
        m = self.model
        k, s, m.history = len(m.states), len(m.symbols), []
        chunks = self.chunks(rows)
        norm = lambda x: (x + 1e-12) / (x + 1e-12).sum(-1, keepdims=True)
        for _ in range(n_iter):
            beside = self._beside(chunks)
            total = self._counted(beside).agg(*[F.sum(F.col("counts")[i]) for i in range(1 + k + k * k + k * s)]).first()
            removed(beside)
            if total[0] is None:
                break
            c = np.array(total, float)
            m.set_parameters(norm(c[1 : 1 + k]), norm(c[1 + k : 1 + k + k * k].reshape(k, k)), norm(c[1 + k + k * k :].reshape(k, s)))
            m.history.append(float(c[0]))
            if len(m.history) > 1 and abs(m.history[-1] - m.history[-2]) < tolerance:
                break
        removed(chunks)
        return self
