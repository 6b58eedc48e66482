"""Workflows around the estimators: sweeps, anomaly thresholds, importance, quantization, with their SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators.clustering import GaussianMixture, KMeans, NaiveBayes, NearestNeighbors
from ..operators.embedding import Autoencoder, IsolationForest, MatrixFactorization
from ..operators.itemsets import Apriori
from ..operators.linear import AdditiveForecast, LeastSquares, PrincipalComponents
from ..operators.trees import DecisionTree
from ..sources.tables import baskets, read
from .factoring import rated
from .grown import draw_sql, factorization_sql
from .lines import LINES, lines

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_OLS = "b as (select (dd * qy - qd * dy) / (qq * dd - qd * qd) as bq, (qq * dy - qd * qy) / (qq * dd - qd * qd) as bd, mq, md, my from (select avg(q) as mq, avg(d) as md, avg(price) as my, var_pop(q) as qq, var_pop(d) as dd, covar_pop(q, d) as qd, covar_pop(q, price) as qy, covar_pop(d, price) as dy from l))"


@query(f"""with {LINES}, {_OLS}, u as (select *, {draw_sql('id', '0')} as u from l), r as (select *, row_number() over (order by u, id, q, d, price) as n, count(*) over () as c from u),
m as (select r.*, q.q as mq_, dd.d as md_ from r join r q on (q.n - 1 + c // 2) % c = r.n - 1 join r dd on dd.n = q.n),
s as (select r.*, x.q as nq, x.d as nd from r join r x on (x.n - 1 + x.c // 2) % x.c = r.n - 1),
e as (select avg(pow(price - (my + bq * (q - mq) + bd * (d - md)), 2)) as base, avg(pow(price - (my + bq * (nq - mq) + bd * (d - md)), 2)) as eq, avg(pow(price - (my + bq * (q - mq) + bd * (nd - md)), 2)) as ed from s, b)
select 'q' as feature, round(eq - base, 5) as importance from e union all select 'd', round(ed - base, 5) from e""")
def permutation_importance(spark, d):
    rows = lines(spark, d)
    model = LeastSquares(["q", "d"], "price").fit(rows)
    found = metrics.permutation_importance(rows.select("id", "q", "d", "price"), ["q", "d"], lambda x: metrics.rmse(model.predict(x), "price") ** 2, "id")
    return spark.createDataFrame([(f, round(v, 5)) for f, v in found.items()], "feature string, importance double")


@query("""with s as (select s_suppkey as id, s_acctbal / 1000 as x, cast(s_nationkey as double) as y, s_nationkey % 3 as c from supplier),
p as (select a.id, a.c, b.c as k, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) as d from s a join s b on a.id <> b.id group by a.id, a.c, b.c),
e as (select id, c, min(case when c = k then d end) as a, min(case when c <> k then d end) as b from p group by id, c)
select id, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 6) as silhouette from e""")
def pairwise_silhouette(spark, d):
    rows = read(spark, d, "supplier").selectExpr("s_suppkey as id", "s_acctbal / 1000 as x", "cast(s_nationkey as double) as y", "s_nationkey % 3 as c")
    return metrics.pairwise_silhouette(rows, ["x", "y"], "c", "id").select("id", F.round("silhouette", 6).alias("silhouette"))


_START = [(0.2, 1.0), (0.5, 3.0), (0.9, 6.0), (0.4, 5.0)]


def _elbow_sql() -> str:
    out, last = [f"with {LINES}"], []
    for k in range(1, len(_START) + 1):
        out.append(f"c{k}_0 as (" + " union all ".join(f"select {i} as k, {a}::double as a, {b}::double as b" for i, (a, b) in enumerate(_START[:k])) + ")")
        for i in range(2):
            out.append(f"c{k}_{i + 1} as (select k, avg(q) as a, avg(price) as b from (select q, price, (select arg_min(k, (q - a) * (q - a) + (price - b) * (price - b)) from c{k}_{i}) as k from l) group by k)")
        last.append(f"select {k} as clusters, round(sum((select min((q - a) * (q - a) + (price - b) * (price - b)) from c{k}_2)), 2) as inertia from l")
    return ", ".join(out) + " " + " union all ".join(last)


@query(_elbow_sql())
def elbow(spark, d):
    rows = lines(spark, d).select("q", "price").persist()
    found = [(k, round(KMeans(["q", "price"], max_iter=2, tol=0, initial=[list(c) for c in _START[:k]]).fit(rows).inertia(rows), 2)) for k in range(1, len(_START) + 1)]
    rows.unpersist()
    return spark.createDataFrame(found, "clusters int, inertia double")


@query("""with t as (select p_partkey as id, p_size / 50 as x, p_retailprice / 2000 as y, cast(p_size > 25 as int) as label from part),
n as (select a.id, a.label as own, b.label, row_number() over (partition by a.id order by sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) as r from t a, t b where a.id % 100 = 0 and b.id % 100 <> 0),
v as (select k, id, own, avg(label) as share from n, (values (1), (3), (7)) s(k) where r <= k group by k, id, own)
select k, round(avg(case when own = case when share > 0.5 then 1 else 0 end then 1.0 else 0.0 end), 6) as accuracy from v group by k""")
def neighbour_sweep(spark, d):
    t = read(spark, d, "part").selectExpr("p_partkey as id", "p_size / 50 as x", "p_retailprice / 2000 as y", "cast(p_size > 25 as int) as label").persist()
    train, test = t.where("id % 100 <> 0"), t.where("id % 100 = 0")
    found = metrics.grid_search([{"k": k} for k in (1, 3, 7)], lambda k: NearestNeighbors(["x", "y"], k=k).fit(train).score(test))
    t.unpersist()
    return spark.createDataFrame([(o["k"], round(v, 6)) for o, v in found], "k int, accuracy double")


@query("""with b as (select distinct o_custkey as tid, o_orderpriority as item from orders), n as (select count(distinct tid) as n from b), g as (select * from (values (0.2), (0.5), (0.8)) s(support), (values (0.5), (0.7)) c(confidence)),
s1 as (select item, count(*) as c from b group by item), s2 as (select x.item as i, y.item as j, count(*) as c from b x join b y on x.tid = y.tid and x.item < y.item group by x.item, y.item),
r as (select i as a, j as b, c from s2 union all select j, i, c from s2)
select cast(support as double) as support, cast(confidence as double) as confidence, (select count(*) from s1, n where c >= support * n) + (select count(*) from s2, n where c >= support * n) as itemsets, (select count(*) from r, n, s1 where s1.item = r.a and r.c >= support * n and r.c / s1.c >= confidence - 1e-9) as rules from g""")
def support_grid(spark, d):
    rows = baskets(read(spark, d, "orders"), "o_custkey", "o_orderpriority").persist()
    found = []
    for support in (0.2, 0.5, 0.8):
        for confidence in (0.5, 0.7):
            m = Apriori(support, confidence, max_size=2).fit(rows)
            found.append((support, confidence, m.itemsets.count(), m.generate_rules().count()))
    rows.unpersist()
    return spark.createDataFrame(found, "support double, confidence double, itemsets long, rules long")


@query("""with o as (select o_custkey as k, o_orderdate as ds, o_orderkey as id, o_totalprice as y from orders), r as (select k, y / lag(y) over (partition by k order by ds, id) - 1 as r from o)
select case when r < -0.2 then 'down' when r > 0.2 then 'up' else 'flat' end as symbol, count(*) as n, round(avg(r), 5) as mean from r where r is not null group by 1""")
def return_bins(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    r = read(spark, d, "orders").select((F.col("o_totalprice") / F.lag("o_totalprice").over(w) - 1).alias("r")).where("r is not null")
    return r.groupBy(F.expr("case when r < -0.2 then 'down' when r > 0.2 then 'up' else 'flat' end").alias("symbol")).agg(F.count("*").alias("n"), F.round(F.avg("r"), 5).alias("mean"))


_PALETTE = [(0.1, 0.45), (0.5, 0.6), (0.9, 0.75)]


@query(f"""with p as (select p_partkey as id, p_size / 50 as x, p_retailprice / 2000 as y from part), c as ({' union all '.join(f'select {k} as k, {a}::double as a, {b}::double as b' for k, (a, b) in enumerate(_PALETTE))}),
n as (select id, arg_min(k, (x - a) * (x - a) + (y - b) * (y - b)) as k, min((x - a) * (x - a) + (y - b) * (y - b)) as e from p, c group by id)
select k as cluster, count(*) as n, round(avg(e), 6) as error from n group by k""")
def quantization(spark, d):
    """Each row takes the nearest of a few colours."""
    rows = read(spark, d, "part").selectExpr("p_partkey as id", "p_size / 50 as x", "p_retailprice / 2000 as y")
    m = KMeans(["x", "y"], 3, max_iter=1, initial=[list(c) for c in _PALETTE])
    m.centers = np.array(_PALETTE)
    out = m.transform(m.predict(rows))
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg(F.least(*[F.col(f"distance_{k}") ** 2 for k in range(3)])), 6).alias("error"))


_MIX = f"""with {LINES}, p as (select price, exp(-0.5 * (price - 2) * (price - 2)) as a, exp(-0.5 * (price - 6) * (price - 6)) as b from l),
r as (select price, a / (a + b) as a, b / (a + b) as b from p),
m as (select avg(a) as wa, avg(b) as wb, sum(a * price) / sum(a) as ma, sum(b * price) / sum(b) as mb, sum(a * price * price) / sum(a) - pow(sum(a * price) / sum(a), 2) + 1e-6 as va, sum(b * price * price) / sum(b) - pow(sum(b * price) / sum(b), 2) + 1e-6 as vb from r),
s as (select flag, price, ln(wa * exp(-0.5 * pow(price - ma, 2) / va) / sqrt(2 * pi() * va) + wb * exp(-0.5 * pow(price - mb, 2) / vb) / sqrt(2 * pi() * vb)) as ld from l, m)"""


@query(_MIX + " select round(-2 * sum(ld) + 5 * ln(count(*)), 2) as bic, round(-2 * sum(ld) + 10, 2) as aic, sum(case when ld < -3.5 then 1 else 0 end)::bigint as anomalies from s")
def mixture_anomalies(spark, d):
    rows = lines(spark, d).select("price").persist()
    m = GaussianMixture(["price"], 2, max_iter=1, initial_means=[[2.0], [6.0]]).fit(rows)
    n = m.predict_proba(rows).where("log_density < -3.5").count()
    out = spark.createDataFrame([(round(float(m.bic(rows)), 2), round(float(m.aic(rows)), 2), n)], "bic double, aic double, anomalies long")
    rows.unpersist()
    return out


@query(f"with {LINES}, s as (select var_samp(q) as a, var_samp(price) as b, covar_samp(q, price) as c, count(*) as n from l) select round(((a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c)) * (n - 1) / n / 2, 6) as noise from s")
def noise_removal(spark, d):
    """What one component of two leaves out, as a mean over the features."""
    rows = lines(spark, d)
    return spark.createDataFrame([(round(-PrincipalComponents(["q", "price"], 1).fit(rows).score(rows), 6),)], "noise double")


@query(f"""with {LINES}, s as (select var_samp(q) as a, var_samp(price) as b, covar_samp(q, price) as c, avg(q) as mq, avg(price) as mp from l), e as (select *, (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) as ev from s), v as (select *, c / sqrt(c * c + pow(ev - a, 2)) as x, (ev - a) / sqrt(c * c + pow(ev - a, 2)) as y from e),
z as (select label, (q - mq) * x + (price - mp) * y as z from l, v),
m as (select label, avg(z) as mu, var_pop(z) + 1e-9 as v, ln(count(*) / (select count(*) from z)) as pr from z group by label)
select z.label, count(*) as n, sum(case when (select arg_max(m.label, pr - 0.5 * ln(2 * pi() * v) - pow(z.z - mu, 2) / (2 * v)) from m) = z.label then 1 else 0 end)::bigint as hits from z group by z.label""")
def components_then_classifier(spark, d):
    rows = lines(spark, d)
    z = PrincipalComponents(["q", "price"], 1).fit(rows).transform(rows)
    column = next(c for c in z.columns if c not in rows.columns)
    found = NaiveBayes([column], "label").fit(z).predict(z)
    return found.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("prediction") == F.col("label")).cast("long")).alias("hits"))


@query("with o as (select cast(o_orderdate as date) as ds, sum(o_totalprice) as y from orders group by 1), c as (select max(y) * 1.5 as cap, min(ds) as first from o), t as (select date_diff('day', first, ds) as t, ln(y / (cap - y)) as z from o, c) select round(regr_slope(z, t), 7) as slope, round(regr_intercept(z, t), 5) as intercept from t")
def logistic_growth(spark, d):
    daily = read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("ds")).agg(F.sum("o_totalprice").alias("y"))
    cap = metrics.first(daily.agg(F.max("y"))) * 1.5
    w = AdditiveForecast(0, yearly_seasonality=False, weekly_seasonality=False, cap=cap).fit(daily).weights
    return spark.createDataFrame([(round(float(w[1]), 7), round(float(w[0]), 5))], "slope double, intercept double")


def _growth_sql(steps: int) -> str:
    """Damped Gauss-Newton steps for two weights by Cramer's rule, each kept only if it lowers the errors."""
    sums = lambda w: f"select sum(r * r) as loss, sum(s * s) as a, sum(s * s * t) as b, sum(s * s * t * t) as c, sum(s * r) as u, sum(s * t * r) as v from (select t, y - cap * p as r, cap * p * (1 - p) as s from (select t, y, cap, 1 / (1 + exp(-({w}.w0 + {w}.w1 * t))) as p from t, {w}))"
    out = [
        "with o as (select cast(o_orderdate as date) as ds, sum(o_totalprice)::double as y from orders group by 1), c as (select max(y) * 1.5 as cap, min(ds) as first from o)",
        "t as materialized (select date_diff('day', first, ds)::double as t, y, cap from o, c)",
        "w0 as materialized (select regr_intercept(z, t) as w0, regr_slope(z, t) as w1, 1e-3 as damp from (select t, ln(y / (cap - y)) as z from t))",
        f"s0 as materialized ({sums('w0')})",
    ]
    for k in range(steps):
        out += [
            f"d{k} as (select a * (1 + damp) as p, b as q, c * (1 + damp) as s, u, v, w0, w1, damp from w{k}, s{k})",
            f"n{k} as materialized (select w0 + (u * s - v * q) / (p * s - q * q) as w0, w1 + (v * p - u * q) / (p * s - q * q) as w1 from d{k})",
            f"x{k} as materialized ({sums(f'n{k}')})",
            f"w{k + 1} as materialized (select case when x.loss < s.loss then n.w0 else w.w0 end as w0, case when x.loss < s.loss then n.w1 else w.w1 end as w1, damp * case when x.loss < s.loss then 0.1 else 10 end as damp from w{k} w, n{k} n, x{k} x, s{k} s)",
            f"s{k + 1} as materialized (select case when x.loss < s.loss then x.loss else s.loss end as loss, " + ", ".join(f"case when x.loss < s.loss then x.{c} else s.{c} end as {c}" for c in "abcuv") + f" from x{k} x, s{k} s)",
        ]
    return ", ".join(out) + " " + " union all ".join(f"select {k} as step, round(sqrt(loss / (select count(*) from t)), 3) as rmse, round(w0, 6) as intercept, round(w1, 8) as slope from s{k}, w{k}" for k in (0, steps))


@query(_growth_sql(3))
def logistic_growth_steps(spark, d):
    """Errors and weights of logistic growth: by its logits, and after three steps on the values themselves."""
    daily = read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("ds")).agg(F.sum("o_totalprice").cast("double").alias("y"))
    cap, n = daily.agg(F.max("y") * 1.5, F.count("*")).first()
    out = []
    for steps in (0, 3):
        m = AdditiveForecast(0, yearly_seasonality=False, weekly_seasonality=False, cap=cap, refine=steps).fit(daily)
        rmse = (m.losses[-1] / n) ** 0.5 if steps else m.rmse(daily)
        out.append((steps, round(rmse, 3), round(float(m.weights[0]), 6), round(float(m.weights[1]), 8)))
    return spark.createDataFrame(out, "step int, rmse double, intercept double, slope double")


@query(factorization_sql(3))
def factorization_losses(spark, d):
    """Losses of the first epochs, at a falling rate."""
    m = MatrixFactorization(2, learning_rate=0.05, decay=0.5, n_epochs=3, patience=3).fit(rated(spark, d))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in enumerate(m.losses)], "epoch int, loss double")


@query(f"with {LINES}, m as (select flag, avg(q) as mq, var_pop(q) + 1e-9 as vq, avg(price) as mp, var_pop(price) + 1e-9 as vp from l group by flag), p as (select l.flag, (select arg_max(m.flag, -ln(3.0) - 0.5 * ln(2 * pi() * vq) - 0.5 * ln(2 * pi() * vp) - pow(l.q - mq, 2) / (2 * vq) - pow(l.price - mp, 2) / (2 * vp)) from m) as prediction from l) select flag, prediction, count(*) as n from p group by 1, 2")
def bayes_predictions(spark, d):
    """Gaussian classes with equal priors."""
    rows = lines(spark, d)
    return metrics.confusion(NaiveBayes(["q", "price"], "flag", equal_priors=True).fit(rows).predict(rows), "flag", "prediction")


@query(f"with {LINES}, s as (select flag, sum(q) as q, sum(d) as d, sum(t) as t, count(*) as n from l group by flag), m as (select flag, ln(n / sum(n) over ()) as pr, (q + 1) / (q + d + t + 3) as pq, (d + 1) / (q + d + t + 3) as pd, (t + 1) / (q + d + t + 3) as pt from s), p as (select l.flag, (select arg_max(m.flag, pr + l.q * ln(pq + 1e-9) + l.d * ln(pd + 1e-9) + l.t * ln(pt + 1e-9)) from m) as prediction from l) select flag, prediction, count(*) as n from p group by 1, 2")
def multinomial_bayes(spark, d):
    rows = lines(spark, d)
    return metrics.confusion(NaiveBayes(["q", "d", "t"], "flag", "multinomial").fit(rows).predict(rows), "flag", "prediction")


@query(f"""with {LINES}, t as (select p_partkey as id, p_size / 50 as x, p_retailprice / 2000 as y, p_retailprice as label from part),
n as (select a.id, b.label, row_number() over (partition by a.id order by abs(a.x - b.x) + abs(a.y - b.y), b.id) as r from t a, t b where a.id % 100 = 0) select id, round(avg(label), 6) as prediction from n where r <= 4 group by id""")
def neighbour_regression(spark, d):
    t = read(spark, d, "part").selectExpr("p_partkey as id", "p_size / 50 as x", "p_retailprice / 2000 as y", "p_retailprice as label")
    m = NearestNeighbors(["x", "y"], k=4, distance_metric="manhattan", task="regression").fit(t)
    return m.predict(t.where("id % 100 = 0")).select("id", F.round("prediction", 6).alias("prediction"))


def _tree_sql(impurity: str, label: str) -> str:
    values = " union all ".join(f"select {i} as f, {c} as v, {label} as y from l" for i, c in enumerate(("q", "d", "t")))
    side = lambda s: impurity.format(s=s)
    return f"""with {LINES}, g as (select f, v, count(*)::double as n, sum(y) as s, sum(y * y) as s2 from ({values}) group by f, v),
p as (select f, v, sum(n) over w as ln, sum(s) over w as ls, sum(s2) over w as ls2, sum(n) over a as tn, sum(s) over a as ts, sum(s2) over a as ts2 from g window w as (partition by f order by v rows unbounded preceding), a as (partition by f)),
r as (select *, tn - ln as rn, ts - ls as rs, ts2 - ls2 as rs2 from p where ln < tn)
select cast(f as bigint) as feature, round(v, 6) as threshold, round(gain, 8) as gain from (select f, v, {side('t')} - ln / tn * {side('l')} - rn / tn * {side('r')} as gain from r) order by round(gain, 12) desc, f, v limit 1"""


def _root(spark, d, **kw):
    root = DecisionTree(["q", "d", "t"], max_depth=1, **kw).fit(lines(spark, d)).tree[0]
    return spark.createDataFrame([(int(root["feature"]), round(root["threshold"], 6), round(root["gain"], 8))], "feature long, threshold double, gain double")


@query(_tree_sql("(-(({s}s / {s}n) * log2({s}s / {s}n + 1e-10) + (1 - {s}s / {s}n) * log2(1 - {s}s / {s}n + 1e-10)))", "label"))
def tree_entropy(spark, d):
    return _root(spark, d, criterion="entropy")


@query(_tree_sql("({s}s2 / {s}n - pow({s}s / {s}n, 2))", "price"))
def tree_regression(spark, d):
    return _root(spark, d, label="price", task="regression")


def _net_sql(epochs: int) -> str:
    """A 2-1-2 autoencoder, tanh and linear, by full-batch steps; its start is that of the seed."""
    rng = np.random.default_rng(42)
    w1, w2 = rng.uniform(-1, 1, (2, 1)) * math.sqrt(2), rng.uniform(-1, 1, (1, 2)) * math.sqrt(2)
    out = [f"with {LINES}", "s as (select min(q) as a, max(q) - min(q) + 1e-8 as b, min(d) as c, max(d) - min(d) + 1e-8 as e from l)", "x as materialized (select flag, (q - a) / b as x, (d - c) / e as y from l, s)"]
    out.append("w0 as (select " + ", ".join(f"{float(v)!r}::double as {n}" for n, v in zip(("p", "r", "c", "u", "v", "m", "n"), (w1[0, 0], w1[1, 0], 0, w2[0, 0], w2[0, 1], 0, 0))) + ")")
    for k in range(epochs):
        out.append(f"f{k} as (select x, y, h, (h * u + m - x) as dx, (h * v + n - y) as dy, u, v from (select *, tanh(x * p + y * r + c) as h from x, w{k}))")
        out.append(f"g{k} as (select *, (dx * u + dy * v) * (1 - h * h) as z from f{k})")
        out.append(f"w{k + 1} as (select " + ", ".join(f"w.{n} - 0.1 * {g} as {n}" for n, g in (("p", "a.p"), ("r", "a.r"), ("c", "a.c"), ("u", "a.u"), ("v", "a.v"), ("m", "a.m"), ("n", "a.n"))) + f" from w{k} w, (select avg(z * x) as p, avg(z * y) as r, avg(z) as c, avg(dx * h) as u, avg(dy * h) as v, avg(dx) as m, avg(dy) as n from g{k}) a)")
    return ", ".join(out) + f" select flag, round(avg(pow((h * u + m - x) * b, 2) + pow((h * v + n - y) * e, 2)) / 2, 5) as error from (select *, tanh(x * p + y * r + x.c0 + w.c) as h from (select *, 0 as c0 from x) x, w{epochs} w, (select b, e from s)) group by flag"


@query(_net_sql(3))
def autoencoder_errors(spark, d):
    rows = lines(spark, d)
    m = Autoencoder(["q", "d"], 1, epochs=3, activation="tanh").fit(rows)
    return m.reconstruction_error(rows).groupBy("flag").agg(F.round(F.avg("error"), 5).alias("error"))


#: A literal isolation forest of two trees on (value, hour): splits and, in leaves, path lengths.
_FOREST = {0: [(0, 0, 50.0, 0.0), (1, 1, 12.0, 0.0), (2, -1, 0.0, 2.5), (3, -1, 0.0, 4.0), (4, 0, 20.0, 0.0), (9, -1, 0.0, 3.0), (10, -1, 0.0, 5.25)], 1: [(0, 1, 6.0, 0.0), (1, -1, 0.0, 1.0), (2, 0, 80.0, 0.0), (5, -1, 0.0, 4.5), (6, -1, 0.0, 2.0)]}


def _isolation_sql(samples: int) -> str:
    def way(tree: int, node: int) -> str:
        _, f, v, length = next(r for r in _FOREST[tree] if r[0] == node)
        return str(length) if f < 0 else f"case when {('value', 'hour')[f]} < {v} then {way(tree, 2 * node + 1)} else {way(tree, 2 * node + 2)} end"

    norm = 2 * (math.log(samples - 1) + 0.5772156649015329) - 2 * (samples - 1) / samples
    return f"with e as (select value, hour(ts) as hour, event_type from events), s as (select event_type, hour, pow(2.0, -(({way(0, 0)}) + ({way(1, 0)})) / 2 / {norm!r}) as anomaly from e) select event_type, cast(hour as int) as hour, count(*) as n, round(avg(anomaly), 6) as anomaly, round(max(anomaly), 6) as most from s group by 1, 2"


@query(_isolation_sql(256))
def isolation_scores(spark, d):
    """Scores of a given forest; fits draw at random."""
    nodes = {t: pd.DataFrame(rows, columns=["node", "feature", "value", "length"]).set_index("node") for t, rows in _FOREST.items()}
    rows = read(spark, d, "events").selectExpr("event_type", "value", "hour(ts) as hour")
    found = IsolationForest(["value", "hour"], nodes=nodes, samples=256).decision_function(rows)
    return found.groupBy("event_type", "hour").agg(F.count("*").alias("n"), F.round(F.avg("anomaly"), 6).alias("anomaly"), F.round(F.max("anomaly"), 6).alias("most"))
