"""Hidden Markov models (sequences in array columns) and topic models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from .factors import BROADCAST_BYTES
from .loop import removed, written


def _lse(x, axis):
    m = np.max(x, axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class _Steps:
    """Codes of several sequences, step by step: the longest sequence first, so those that go on are the first of a step."""

    def __init__(self, codes: list[np.ndarray]) -> None:
        length = np.array([len(c) for c in codes])
        self.order = np.argsort(-length, kind="stable")
        self.length = length[self.order]
        self.n = np.searchsorted(-self.length, -np.arange(self.length[0]))  # sequences that have this step
        self.start = np.cumsum(self.n) - self.n
        step = np.concatenate([np.arange(n) for n in self.length])
        rank = np.repeat(np.arange(len(codes)), self.length)
        self.place = self.start[step] + rank  # of each sequence's codes, in the order of `order`
        self.code, self.rank, at = (np.empty(len(step), int) for _ in range(3))
        self.code[self.place], self.rank[self.place], at[self.place] = np.concatenate([codes[i] for i in self.order]), rank, step
        self.first, self.ends = int(self.n[0]), self.start[self.length - 1] + np.arange(len(codes))
        self.came = self.start[np.maximum(at - 1, 0)] + self.rank  # the step before

    def split(self, values: np.ndarray) -> list:
        """(place in the batch, (values of the sequence,))."""
        return [(i, (v.tolist(),)) for i, v in zip(self.order, np.split(values[self.place], np.cumsum(self.length)[:-1]))]

    def alpha(self, pi, a, b) -> np.ndarray:
        out = b.T[self.code]
        out[: self.first] += pi
        for t in range(1, len(self.n)):
            before, lo, n = self.start[t - 1], self.start[t], self.n[t]
            out[lo : lo + n] += _lse(out[before : before + n, :, None] + a[None], 1)
        return out

    def beta(self, a, b) -> np.ndarray:
        out, seen = np.zeros((len(self.code), len(a))), b.T[self.code]
        for t in range(len(self.n) - 1, 0, -1):
            before, lo, n = self.start[t - 1], self.start[t], self.n[t]
            out[before : before + n] = _lse(a[None] + (seen[lo : lo + n] + out[lo : lo + n])[:, None], 2)
        return out

    def best_paths(self, pi, a, b) -> tuple[np.ndarray, np.ndarray]:
        """The state of each code on its sequence's best path, and the log probabilities of the paths."""
        best, came = b.T[self.code], np.zeros((len(self.code), len(a)), np.int32)
        best[: self.first] += pi
        for t in range(1, len(self.n)):
            before, lo, n = self.start[t - 1], self.start[t], self.n[t]
            reach = best[before : before + n, :, None] + a[None]
            came[lo : lo + n] = reach.argmax(1)
            best[lo : lo + n] += reach.max(1)
        state = best.argmax(1)
        for t in range(len(self.n) - 1, 0, -1):
            before, lo, n = self.start[t - 1], self.start[t], self.n[t]
            state[before : before + n] = came[np.arange(lo, lo + n), state[lo : lo + n]]
        return state, best[self.ends].max(1)


@dataclass
class HiddenMarkov:
    """sequences: (seq_id, symbols array<string>).  All recursions in log space; an unknown symbol has probability eps."""

    states: list[str]
    symbols: list[str]
    initial: np.ndarray | None = None
    transition: np.ndarray | None = None
    emission: np.ndarray | None = None
    eps: float = 1e-10
    seed: int = 0
    history: list[float] | None = None

    def __post_init__(self):
        rng, k, m = np.random.default_rng(self.seed), len(self.states), len(self.symbols)
        if self.initial is None:
            self.set_parameters(np.full(k, 1 / k), *(x / x.sum(1, keepdims=True) for x in (rng.random((k, k)) + 0.1, rng.random((k, m)) + 0.1)))
        else:
            self.set_parameters(self.initial, self.transition, self.emission)

    def set_parameters(self, initial, transition, emission) -> HiddenMarkov:
        self.initial, self.transition, self.emission = (np.array(x, float) for x in (initial, transition, emission))
        if not all(np.allclose(x.sum(-1), 1) for x in (self.initial, self.transition, self.emission)):
            raise ValueError("probabilities must add up to 1")
        return self

    def _logs(self):
        with np.errstate(divide="ignore"):
            return np.log(self.initial), np.log(self.transition), np.log(np.hstack([self.emission, np.full((len(self.states), 1), self.eps)])), {s: i for i, s in enumerate(self.symbols)}

    def _each(self, df: DataFrame, work, ddl: str) -> DataFrame:
        """work(steps, logs) -> rows of seq_id's place and values, for the sequences of a batch at once."""
        pi, a, b, code = self._logs()
        last = b.shape[1] - 1
        names = ["seq_id", *[c.split()[0] for c in ddl.split(", ")]]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                own = part[[o is not None and len(o) > 0 for o in part["symbols"]]]
                ids = own["seq_id"].to_numpy()
                rows = work(_Steps([np.array([code.get(s, last) for s in o]) for o in own["symbols"]]), pi, a, b) if len(own) else []
                yield pd.DataFrame([(None if i is None else ids[i], *v) for i, v in rows], columns=names)

        return df.select("seq_id", "symbols").mapInPandas(run, f"seq_id {df.schema['seq_id'].dataType.simpleString()}, {ddl}")

    def score(self, df: DataFrame) -> DataFrame:
        """(seq_id, log_likelihood, perplexity)."""

        def work(o, pi, a, b):
            ll = _lse(o.alpha(pi, a, b)[o.ends], 1)
            return [(i, (float(x), float(np.exp(-x / n)))) for i, x, n in zip(o.order, ll, o.length)]

        return self._each(df, work, "log_likelihood double, perplexity double")

    def forward(self, df: DataFrame) -> DataFrame:
        return self._each(df, lambda o, pi, a, b: o.split(o.alpha(pi, a, b)), "alpha array<array<double>>")

    def backward(self, df: DataFrame) -> DataFrame:
        return self._each(df, lambda o, pi, a, b: o.split(o.beta(a, b)), "beta array<array<double>>")

    def predict(self, df: DataFrame) -> DataFrame:
        """(seq_id, path, log_probability) of the best path."""
        names = np.array(self.states, object)

        def viterbi(o, pi, a, b):
            path, best = o.best_paths(pi, a, b)
            return [(i, (p, float(x))) for (i, (p,)), x in zip(o.split(names[path]), best)]

        return self._each(df, viterbi, "path array<string>, log_probability double")

    def fit(self, df: DataFrame, n_iter: int = 100, tolerance: float = 1e-4) -> HiddenMarkov:
        """Baum-Welch: expected counts of the sequences of a batch, summed by Spark, give the next parameters."""
        k, m, self.history = len(self.states), len(self.symbols), []

        def counts(o, pi, a, b):
            al, be = o.alpha(pi, a, b), o.beta(a, b)
            ll = _lse(al[o.ends], 1)
            g = np.exp(al + be - ll[o.rank, None])
            xi = np.zeros_like(a)
            for lo in range(o.first, len(al), 1 << 16):
                to = slice(lo, lo + (1 << 16))
                xi += np.exp(al[o.came[to]][:, :, None] + a[None] + (b.T[o.code[to]] + be[to])[:, None] - ll[o.rank[to], None, None]).sum(0)
            e = np.stack([np.bincount(o.code, g[:, s], m + 1) for s in range(k)])
            return [(None, (np.concatenate([[ll.sum()], g[: o.first].sum(0), xi.ravel(), e[:, :m].ravel()]).tolist(),))]

        rows = df.select("seq_id", "symbols").persist()
        for _ in range(n_iter):
            n = 1 + k + k * k + k * m
            s = np.array(self._each(rows, counts, "c array<double>").agg(*[F.sum(F.col("c")[i]) for i in range(n)]).first(), float)
            norm = lambda x: (x + 1e-12) / (x + 1e-12).sum(-1, keepdims=True)
            self.set_parameters(norm(s[1 : 1 + k]), norm(s[1 + k : 1 + k + k * k].reshape(k, k)), norm(s[1 + k + k * k :].reshape(k, m)))
            self.history.append(float(s[0]))
            if len(self.history) > 1 and abs(self.history[-1] - self.history[-2]) < tolerance:
                break
        rows.unpersist()
        return self

    def sample(self, spark, n_sequences: int, length: int = 10, seed: int = 0) -> DataFrame:
        pi, a, e, states, symbols = self.initial, self.transition, self.emission, self.states, self.symbols

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = []
                for i in part["id"]:
                    rng, path = np.random.default_rng([seed, i]), []
                    for t in range(length):
                        path.append(int(rng.choice(len(pi), p=pi if t == 0 else a[path[-1]])))
                    out.append((i, [symbols[rng.choice(e.shape[1], p=e[s])] for s in path], [states[s] for s in path]))
                yield pd.DataFrame(out, columns=["seq_id", "symbols", "path"])

        return spark.range(n_sequences).mapInPandas(run, "seq_id long, symbols array<string>, path array<string>")


#: Terms whose counts go to all tasks: the most frequent, which most tokens are of.
FREQUENT = 100_000


@dataclass
class TopicModel:
    """Latent Dirichlet allocation on counts (doc, term, cnt).  Each sweep samples a topic for all tokens from the counts of
    the sweep before (approximate distributed Gibbs): a token's weights are joined counts, and its draw a hash.

    Tokens are dealt by document in each sweep.  Those of frequent terms find their term's counts in every task; only the few of
    rare terms are dealt by term, before, and take the counts along.
    """

    n_topics: int = 10
    max_iter: int = 20
    alpha: float = 0.1
    beta: float = 0.01
    seed: int = 0
    topics: DataFrame | None = None  # term, phi array<double>
    n_terms: int = 0

    def _sweep(self, tokens: DataFrame, by_term: DataFrame, total: DataFrame | None, t: int, frequent: DataFrame | None = None) -> DataFrame:
        k = self.n_topics
        own = Window.partitionBy("doc")
        counted = {f"d{i}": F.count_if(F.col("z") == i).over(own) for i in range(k)}
        if frequent is None:
            joined = tokens.withColumns(counted).join(by_term, "term")
        else:
            # What is dealt of most tokens is a document and a number, of the term's code, nth and z; the rest is found after it.
            names = F.broadcast(frequent)
            number = f"(cast({{}} as bigint) * {1 << 31}L + nth) * {k} + z"
            rare = tokens.join(names, "term", "left_anti").join(by_term.join(names, "term", "left_anti"), "term").select("doc", F.expr(number.format(FREQUENT)).alias("number"), F.col("term").alias("own_term"), F.col("tn").alias("own_tn"))
            often = tokens.join(names, "term").select("doc", F.expr(number.format("code")).alias("number"), F.lit(None).cast(tokens.schema["term"].dataType).alias("own_term"), F.lit(None).cast("array<double>").alias("own_tn"))
            dealt = often.unionByName(rare).repartition("doc").select("doc", "own_term", "own_tn", F.expr(f"cast(number % {k} as int)").alias("z"), F.expr(f"cast((number div {k}) % {1 << 31}L as int)").alias("nth"), F.expr(f"cast(number div {k * (1 << 31)}L as int)").alias("code"))
            joined = dealt.withColumns(counted).join(F.broadcast(by_term.join(names, "term")), "code", "left").withColumns({"term": F.coalesce("term", "own_term"), "tn": F.coalesce("tn", "own_tn")})
        if total is not None:
            joined = joined.crossJoin(F.broadcast(total))
            w = lambda i: f"(d{i} - if(z = {i}, 1, 0) + {self.alpha}D) * (tn[{i}] - if(z = {i}, 1, 0) + {self.beta}D) / (al[{i}] - if(z = {i}, 1, 0) + {self.beta * self.n_terms}D)"
        else:
            w = lambda i: f"(d{i} - if(z = {i}, 1, 0) + {self.alpha}D) * phi[{i}]"
        # A column a topic, not a function over an array: those are compiled, and each weight is worked out once.
        for i in range(k):
            joined = joined.withColumn(f"c{i}", F.expr(f"{f'c{i - 1}' if i else '0D'} + {w(i)}"))
        joined = joined.withColumn("u", F.expr(f"pmod(xxhash64({self.seed}, {t}, doc, term, nth), 1073741824) / 1073741824D * c{k - 1}"))
        passed = " + ".join(f"if(c{i} <= u, 1, 0)" for i in range(k))
        return joined.select("doc", "term", "nth", F.expr(f"cast(least({k - 1}, {passed}) as int)").alias("z"))

    def _counts(self, tokens: DataFrame, key: str, name: str) -> DataFrame:
        return tokens.groupBy(*([key] if key else [])).agg(F.array(*[F.count_if(F.col("z") == i).cast("double") for i in range(self.n_topics)]).alias(name))

    def _start(self, counts: DataFrame) -> DataFrame:
        tokens = counts.where("cnt > 0 and doc is not null and term is not null").select("doc", "term", F.explode(F.expr("sequence(1, cast(cnt as int))")).alias("nth"))
        return written(tokens.withColumn("z", F.expr(f"cast(pmod(xxhash64({self.seed}, doc, term, nth), {self.n_topics}) as int)")))

    def _frequent(self, totals: DataFrame) -> DataFrame:
        """(term, code) of FREQUENT terms at most, the first the most frequent: those with at least some power of two of tokens, of
        all terms (term, n)."""
        size, least = totals.where("term is not null and n > 0").groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*")).collect(), 63
        most = min(FREQUENT, BROADCAST_BYTES // (64 + 8 * self.n_topics))
        for b, n in sorted(size, reverse=True):
            most -= n
            if most < 0:
                break
            least = b
        found = totals.where(F.col("term").isNotNull() & (F.floor(F.log2("n")) >= least))
        return written(found.select("term", (F.row_number().over(Window.orderBy(F.desc("n"), "term")) - 1).alias("code")))

    def fit(self, counts: DataFrame) -> TopicModel:
        counts = written(counts.select("doc", "term", "cnt"))
        totals = written(counts.groupBy("term").agg(F.sum(F.expr("if(cnt > 0 and doc is not null, cnt, 0)")).alias("n")))
        self.n_terms, frequent = totals.count(), self._frequent(totals)
        tokens = self._start(counts)
        removed(counts, totals)
        for t in range(self.max_iter):
            by_term = written(self._counts(tokens, "term", "tn"))
            last, tokens = tokens, written(self._sweep(tokens, by_term, self._counts(tokens, "", "al"), t, frequent))
            removed(last, by_term)
        removed(frequent)
        total = self._counts(tokens, "", "al")
        self.topics = written(self._counts(tokens, "term", "tn").crossJoin(F.broadcast(total)).select("term", F.expr(f"zip_with(tn, al, (n, a) -> (n + {self.beta}D) / (a + {self.beta * self.n_terms}D))").alias("phi")))
        return self

    def transform(self, counts: DataFrame, sweeps: int = 10) -> DataFrame:
        """(doc, theta): topic shares with the topics' word shares fixed."""
        tokens = self._start(counts.join(self.topics.select("term"), "term", "left_semi"))
        for t in range(sweeps):
            last, tokens = tokens, written(self._sweep(tokens, self.topics, None, 1000 + t))
            removed(last)
        return self._counts(tokens, "doc", "dn").select("doc", F.expr(f"transform(dn, x -> (x + {self.alpha}D) / (aggregate(dn, 0D, (s, y) -> s + y) + {self.alpha * self.n_topics}D))").alias("theta"))

    def perplexity(self, counts: DataFrame, theta: DataFrame) -> float:
        p = counts.join(theta, "doc").join(self.topics, "term").select("cnt", F.expr("aggregate(zip_with(theta, phi, (a, b) -> a * b), 0D, (s, x) -> s + x)").alias("p"))
        return metrics.first(p.agg(F.expr("exp(-sum(cnt * ln(p)) / sum(cnt))")))

    def get_top_words(self, n: int = 10) -> DataFrame:
        each = self.topics.select("term", F.posexplode("phi").alias("topic", "share"))
        return each.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("share"), "term"))).where(F.col("rank") <= n)
