"""Factorizations beyond the plain one: implicit feedback, social edges; their SQL solves or steps the same equations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.embedding import MatrixFactorization
from ..operators.factors import ImplicitFactorization
from ..operators.loop import removed, written
from ..sources.tables import read
from .grown import _RATED, draw_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def bought(spark: SparkSession, d: str) -> DataFrame:
    """How much customers bought of suppliers, in lots of 50."""
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item"), (F.col("l_quantity") / 50).alias("rating"))


def rated(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    # A customer's rows come to one task, so that grouped sums by customer are small ever after.
    return rows.repartition("o_custkey").groupBy(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item")).agg(F.expr("least(5D, greatest(1D, avg(l_quantity) / 10))").alias("rating"))


def normal_sql(c: str, side: str, j: int) -> str:
    return f"sqrt(-2 * ln(1 - {draw_sql(c, f'0:{j}:{side}')})) * cos(2 * pi() * {draw_sql(c, f'0:{j}:{side}2')}) * 0.1"


def alternating_sql(sweeps: int, alpha: float, ridge: float) -> list[str]:
    """CTEs of the sweeps with two factors: u1, i1, u2, ..., each solved by Cramer's rule."""
    out = [
        "with r as materialized (select o_custkey as u, l_suppkey as i, sum(l_quantity / 50)::double as r from lineitem join orders on l_orderkey = o_orderkey group by 1, 2 having sum(l_quantity / 50) > 0)",
        f"i0 as materialized (select i, {normal_sql('i', 'item', 0)} as f0, {normal_sql('i', 'item', 1)} as f1 from (select distinct i from r))",
    ]
    for k in range(sweeps):
        for c, other, fixed in (("u", "i", f"i{k}"), ("i", "u", f"u{k + 1}")):
            name = f"{c}{k + 1}"
            out += [
                f"{name}g as (select sum(f0 * f0) as g00, sum(f0 * f1) as g01, sum(f1 * f1) as g11 from {fixed})",
                f"{name}n as (select {c}, sum({alpha} * r * f0 * f0) as a00, sum({alpha} * r * f0 * f1) as a01, sum({alpha} * r * f1 * f1) as a11, sum((1 + {alpha} * r) * f0) as b0, sum((1 + {alpha} * r) * f1) as b1 from r join {fixed} using ({other}) group by {c})",
                f"{name}m as (select {c}, g00 + a00 + {ridge} as p, g01 + a01 as q, g11 + a11 + {ridge} as s, b0, b1 from {name}n, {name}g)",
                f"{name} as materialized (select {c}, (b0 * s - b1 * q) / (p * s - q * q) as f0, (b1 * p - b0 * q) / (p * s - q * q) as f1 from {name}m)",
            ]
    return out


def _losses_sql(sweeps: int, alpha: float, ridge: float) -> str:
    out = alternating_sql(sweeps, alpha, ridge)
    for k in range(1, sweeps + 1):
        x = "(x.f0 * y.f0 + x.f1 * y.f1)"
        out.append(f"o{k} as (select sum((1 + {alpha} * r) * pow(1 - {x}, 2) - pow({x}, 2)) as e from r join u{k} x using (u) join i{k} y using (i))")
        out += [f"s{k}{c} as (select sum(f0 * f0) as g00, sum(f0 * f1) as g01, sum(f1 * f1) as g11 from {c}{k})" for c in "ui"]
    each = (f"select {k - 1} as sweep, round(e + a.g00 * b.g00 + 2 * a.g01 * b.g01 + a.g11 * b.g11 + {ridge} * (a.g00 + a.g11 + b.g00 + b.g11), 4) as loss from o{k}, s{k}u a, s{k}i b" for k in range(1, sweeps + 1))
    return ", ".join(out) + " " + " union all ".join(each)


@query(_losses_sql(3, 40.0, 0.1))
def implicit_factorization(spark, d):
    """Losses of the first sweeps."""
    m = ImplicitFactorization(2, n_epochs=3).fit(bought(spark, d))
    return spark.createDataFrame([(k, round(v, 4)) for k, v in enumerate(m.losses)], "sweep int, loss double")


@query(", ".join(alternating_sql(2, 40.0, 0.1)) + ', p as (select u, i, x.f0 * y.f0 + x.f1 * y.f1 as p from u2 x, i2 y where not exists (select 1 from r where r.u = x.u and r.i = y.i)) select u as "user", i as item, round(p, 6) as prediction, cast(row_number() over (partition by u order by p desc, i) as int) as rank from p qualify rank <= 3')
def implicit_recommendations(spark, d):
    """Each customer's first suppliers that it has not bought from."""
    m = ImplicitFactorization(2, n_epochs=2).fit(bought(spark, d))
    return m.recommend(m.users, 3).select("user", "item", F.round("prediction", 6).alias("prediction"), "rank")


def chained(rows: DataFrame) -> DataFrame:
    """(user, friend): each user of an item and the next one by number, so an item of n users gives n - 1 edges; a pair may come from several."""
    w = Window.partitionBy("item").orderBy("user")
    return rows.select("user", F.lead("user").over(w).alias("friend")).where("friend is not null")


def _social_sql(epochs: int, rate: float, reg: float, social: float) -> str:
    out = [f"with {_RATED}", "mu as (select avg(r) as mu from r)", "c as (select u, lead(u) over (partition by i order by u) as v from r)", "e as materialized (select distinct u, v from (select u, v from c where v is not null union all select v, u from c where v is not null) where u <> v)"]
    for side, c in (("user", "u"), ("item", "i")):
        out.append(f"{c}0 as materialized (select {c}, 0.0::double as b, {normal_sql(c, side, 0)} as f0, {normal_sql(c, side, 1)} as f1 from (select distinct {c} from r))")
    for k in range(epochs):
        out += [
            f"d{k} as materialized (select u, i, r - least(5, greatest(1, mu + x.b + y.b + x.f0 * y.f0 + x.f1 * y.f1)) as e, x.b as bu, y.b as bi, x.f0 as u0, x.f1 as u1, y.f0 as v0, y.f1 as v1 from r join u{k} x using (u) join i{k} y using (i), mu)",
            f"n{k} as (select e.u, avg(x.f0) as n0, avg(x.f1) as n1 from e join u{k} x on x.u = e.v group by e.u)",
            f"s{k} as (select u, any_value(bu) as b, any_value(u0) as u0, any_value(u1) as u1, count(*) as n, sum(e) as se, sum(e * v0) as g0, sum(e * v1) as g1 from d{k} group by u)",
            f"u{k + 1} as materialized (select u, b + {rate} * (se - {reg} * n * b) as b, " + ", ".join(f"u{j} + {rate} * (g{j} - {reg} * n * u{j}) + coalesce({rate} * {social} * (n{j} - u{j}), 0) as f{j}" for j in (0, 1)) + f" from s{k} left join n{k} using (u))",
            f"i{k + 1} as materialized (select i, any_value(bi) + {rate} * (sum(e) - {reg} * count(*) * any_value(bi)) as b, " + ", ".join(f"any_value(v{j}) + {rate} * (sum(e * u{j}) - {reg} * count(*) * any_value(v{j})) as f{j}" for j in (0, 1)) + f" from d{k} group by i)",
        ]
    friends = f"select 'distance of friends' as what, round(avg(pow(x.f0 - y.f0, 2) + pow(x.f1 - y.f1, 2)), 6) as value from e join u{epochs} x on x.u = e.u join u{epochs} y on y.u = e.v"
    return ", ".join(out) + " " + " union all ".join(f"select 'loss {k}' as what, round(avg(e * e), 6) as value from d{k}" for k in range(epochs)) + f" union all {friends}"


@query(_social_sql(3, 0.01, 0.02, 5.0))
def social_factorization(spark, d):
    """Losses of the first epochs, and how far customers of one supplier are apart after them."""
    r = written(rated(spark, d))
    edges = chained(r)
    m = MatrixFactorization(2, learning_rate=0.01, n_epochs=3, social=5.0).fit(r, edges)
    # A pair is as far apart one way as the other: each once.
    apart = m.friends.where("user < friend").join(m.users.select("user", F.col("u").alias("x")), "user").join(m.users.select(F.col("user").alias("friend"), F.col("u").alias("y")), "friend").agg(F.avg(F.expr("pow(x[0] - y[0], 2) + pow(x[1] - y[1], 2)"))).first()[0]
    removed(r)
    return spark.createDataFrame([(f"loss {k}", round(v, 6)) for k, v in enumerate(m.losses)] + [("distance of friends", round(apart, 6))], "what string, value double")
