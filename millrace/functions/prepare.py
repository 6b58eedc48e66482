"""Preparing columns: scaling, power transforms, encodings, feature selection, text terms, splits and samples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import num


def scale(df: DataFrame, features: list[str], kind: str = "standard") -> DataFrame:
    """df with {feature}_scaled: (x - mean) / population deviation, or (x - min) / (max - min).  A constant feature gives 0."""
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown kind {kind!r}")
    low, wide = ("avg({0})", "stddev_pop({0})") if kind == "standard" else ("min({0})", "max({0}) - min({0})")
    r = df.agg(*[F.expr(e.format(f)).cast("double") for f in features for e in (low, wide)]).first()
    if r[0] is None:
        return df.withColumns({f"{f}_scaled": F.lit(None).cast("double") for f in features})
    return df.withColumns({f"{f}_scaled": F.expr(f"({f} - {num(r[2 * i])}) / {num(r[2 * i + 1] or 1.0)}") for i, f in enumerate(features)})


def power(column: str, lam: float, kind: str = "yeo-johnson") -> str:
    """The transform as SQL text; Box-Cox is for values above 0."""
    up = lambda x, p: f"ln({x})" if abs(p) < 1e-12 else f"(pow({x}, {num(p)}) - 1) / {num(p)}"
    if kind == "box-cox":
        return up(column, lam)
    if kind != "yeo-johnson":
        raise ValueError(f"unknown kind {kind!r}")
    return f"case when {column} >= 0 then {up(f'({column} + 1)', lam)} else -({up(f'(1 - {column})', 2 - lam)}) end"


def power_exponent(df: DataFrame, column: str, kind: str = "yeo-johnson", grid: list[float] | None = None) -> float:
    """The exponent of the grid (-2 to 2 by tenths) of greatest normal likelihood: one aggregate for all, the least on a tie."""
    grid = grid or [round(float(g), 6) for g in np.arange(-20, 21) / 10]
    jacobian = f"sum(ln({column}))" if kind == "box-cox" else f"sum(signum({column}) * ln(abs({column}) + 1))"
    r = df.agg(*[F.expr(f"-0.5D * count({column}) * ln(var_pop({power(column, g, kind)})) + {num(g - 1)} * {jacobian}") for g in grid]).first()
    known = [(v, -g) for v, g in zip(r, grid) if v is not None and np.isfinite(v)]
    if not known:
        raise ValueError(f"no likelihood of {column}")
    return -max(known)[1]


def chi_square(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, statistic) of counts or other values from 0 up against classes: class sums against class shares of the total."""
    long = df.where(F.col(label).isNotNull()).select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("x")) for f in features])).alias("e"))
    cells = long.groupBy(F.col("e.feature").alias("feature"), label).agg(F.sum("e.x").alias("seen"), F.count("*").alias("n"))
    w = Window.partitionBy("feature")
    cells = cells.select("feature", "seen", (F.sum("seen").over(w) * F.col("n") / F.sum("n").over(w)).alias("due"))
    return cells.groupBy("feature").agg(F.expr("sum(case when due = 0 then 0 else (seen - due) * (seen - due) / due end)").alias("statistic"))


def select_best(df: DataFrame, features: list[str], label: str, k: int) -> list[str]:
    """The k features of greatest chi-square statistic, ties by name."""
    return [r["feature"] for r in chi_square(df, features, label).orderBy(F.desc("statistic"), "feature").limit(k).collect()]


def levels(df: DataFrame, column: str, max_levels: int = 10_000) -> list:
    """The distinct values in order; more than max_levels raise an error, as they come to the driver."""
    found = [r[0] for r in df.select(column).distinct().where(F.col(column).isNotNull()).limit(max_levels + 1).collect()]
    if len(found) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} values")
    return sorted(found)


def label_encode(df: DataFrame, column: str, max_levels: int = 10_000) -> DataFrame:
    """df with {column}_code: the value's place in sorted order, from 0; null for null."""
    known = levels(df, column, max_levels)
    codes = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(known)], f"`{column}` {df.schema[column].dataType.simpleString()}, `{column}_code` int")
    return df.join(F.broadcast(codes), column, "left")


def one_hot(df: DataFrame, column: str, max_levels: int = 200) -> DataFrame:
    """df with a 0/1 column {column}_{value} for each value; null has all 0."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in levels(df, column, max_levels)})


def _counted(ngrams: int, stop: frozenset, shortest: int, chunk: int = 1 << 18):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of (key, term, cnt) for each term of a key, some chunk of rows at a time."""
        for batch in batches:
            at, names, counts = [], [], []
            for row, texts in enumerate(batch.column("texts_").to_pylist()):
                found = Counter()
                for text in texts:
                    words = [w for w in text.split() if len(w) >= shortest and w not in stop]
                    found.update(words)
                    for n in range(2, ngrams + 1):
                        found.update(map(" ".join, zip(*(words[i:] for i in range(n)))))
                at += [row] * len(found)
                names += found.keys()
                counts += found.values()
                if len(at) >= chunk:
                    yield out(batch, at, names, counts)
                    at, names, counts = [], [], []
            if at:
                yield out(batch, at, names, counts)

    def out(batch: pa.RecordBatch, at: list, names: list, counts: list) -> pa.RecordBatch:
        rows = pa.array(at, pa.int32())
        own = [c for c in batch.schema.names if c != "texts_"]
        return pa.record_batch([*(batch.column(c).take(rows) for c in own), pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=[*own, "term", "cnt"])

    return run


def counted(df: DataFrame, key: str, words: Column, ngrams: int = 1, stop_words: tuple[str, ...] = (), shortest: int = 1, beside: str | None = None) -> DataFrame:
    """(key, term, cnt) of texts whose words, of `shortest` characters at least, stand between white space; a gram lies in one text.

    The texts of a key meet in one row, which counts its own terms: what is dealt out is each text once, not its terms.
    With `beside`, that column is a list of its values, not null, in the key's rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(key, words.alias("text_"), *([beside] if beside else [])).repartition(parts, key)
    rows = rows.groupBy(key).agg(F.collect_list("text_").alias("texts_"), *([F.collect_list(beside).alias(beside)] if beside else []))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "texts_")
    return rows.mapInArrow(_counted(ngrams, frozenset(stop_words), shortest), f"{own}, term string, cnt long")


def terms(df: DataFrame, key: str, text: str, ngrams: int = 1, stop_words: tuple[str, ...] = (), beside: str | None = None) -> DataFrame:
    """(key, term, cnt) of cleaned texts: lower case, no addresses, only letters a to z; terms of 1 to ngrams words."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), r"http\S+", ""), r"[^a-z\s]", "")
    return counted(df, key, clean, ngrams, stop_words, beside=beside)


def vocabulary(counts: DataFrame, key: str, n_docs: int, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, df, cnt) of the terms in min_df documents or more and a share max_df of them or less; max_features is a top-k
    of total counts, ties by term."""
    out = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("cnt").alias("cnt")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    return out.orderBy(F.desc("cnt"), "term").limit(max_features) if max_features else out


def draw(key: str, seed: int | str = 0) -> str:
    """A number of [0, 1) from a key, as SQL text; the same on every run and partitioning."""
    return f"cast(conv(substr(md5(concat('{seed}:', cast({key} as string))), 1, 8), 16, 10) as double) / 4294967296D"


def split(df: DataFrame, key: str, share: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key."""
    test = F.coalesce(F.expr(draw(key, seed)), F.lit(0.0)) < share
    return df.where(~test), df.where(test)


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """df with fold, 0 to k - 1."""
    return df.withColumn("fold", F.expr(f"cast(floor({draw(key, seed)} * {k}) as int)"))


def split_groups(df: DataFrame, group: str, order: list[str], share: float = 0.2) -> DataFrame:
    """df with is_test: the last share (rounded down) of each group's rows in order."""
    w = Window.partitionBy(group)
    late = F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("is_test", late <= F.floor(F.count("*").over(w) * share))


def split_time(df: DataFrame, order: str, share: float = 0.2) -> DataFrame:
    """df with is_test: rows beyond the (1 - share) percentile of order (a number, date or timestamp)."""
    at = F.col(order).cast("timestamp").cast("double") if df.schema[order].dataType.typeName() in ("date", "timestamp") else F.col(order).cast("double")
    cut = df.agg(F.percentile_approx(at, 1 - share, 100_000)).first()[0]
    return df.withColumn("is_test", at > F.lit(cut))


def goss(df: DataFrame, gradient: str, key: str, top: float = 0.2, other: float = 0.1, seed: int = 0) -> DataFrame:
    """Gradient-based one-side sample: rows at or above the (1 - top) percentile of |gradient| with weight 1, and a hash
    sample of the rest, other of all rows, with weight (1 - top) / other.  The percentile is a mergeable summary, so nothing is sorted."""
    size = F.abs(gradient)
    cut = df.agg(F.percentile_approx(size, 1 - top, 100_000)).first()[0]
    out = df.withColumn("weight", F.when(size >= cut, 1.0).when(F.expr(draw(key, seed)) < other / (1 - top), (1 - top) / other))
    return out.where("weight is not null")
