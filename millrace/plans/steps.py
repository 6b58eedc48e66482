"""First rounds of the iterative estimators, which SQL can follow step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.linear import AdditiveForecast
from ..operators.sequences import HiddenMarkov
from ..operators.trees import AdaBoost, Boosting, LambdaRank, splits
from ..sources.tables import read, sequences
from .estimators import _graded, one
from .lines import LINES, lines

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_LONG = "select 0 as f, q as v, * from {0} union all select 1, d, * from {0} union all select 2, t, * from {0}"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def _adaboost_sql(rounds: int) -> str:
    out = [f"with {LINES}", "w0 as (select id, q, d, t, case when label = 1 then 1 else -1 end as y, 1.0::double / count(*) over () as w from l)"]
    for k in range(rounds):
        out.append(f"""g{k} as (select f, v, sum(case when y > 0 then w else 0 end) as p, sum(case when y < 0 then w else 0 end) as m, count(*) as n from ({_LONG.format(f"w{k}")}) group by f, v),
c{k} as (select f, v, sum(p) over a as lp, sum(m) over a as lm, sum(n) over a as ln, sum(p) over b as tp, sum(m) over b as tm, sum(n) over b as tn from g{k} window a as (partition by f order by v rows unbounded preceding), b as (partition by f)),
b{k} as (select f, v, lp + tm - lm as miss, lm + tp - lp as other from c{k} where ln < tn order by round(greatest(1 - (lp + tm - lm), 1 - (lm + tp - lp)), 12) desc, f, v limit 1),
s{k} as (select f, v, case when miss <= other then 1 else -1 end as pol, 0.5 * ln((1 - least(miss, other)) / least(miss, other)) as alpha from b{k}),
u{k} as (select w{k}.*, w * case when (case when case f when 0 then q when 1 then d else t end <= v then -pol else pol end) <> y then exp(alpha) else 1 end as nw from w{k}, s{k}),
w{k + 1} as (select id, q, d, t, y, nw / sum(nw) over () as w from u{k})""")
    return ", ".join(out) + " " + " union all ".join(f"select {k} as learner, case f when 0 then 'q' when 1 then 'd' else 't' end as feature, round(v, 6) as threshold, pol as polarity, round(alpha, 6) as alpha from s{k}" for k in range(rounds))


@query(_adaboost_sql(2))
def adaboost_rounds(spark, d):
    rows = lines(spark, d).withColumn("label", F.expr("case when label = 1 then 1 else -1 end"))
    found = AdaBoost(["q", "d", "t"], n_estimators=2).fit(rows).learners(spark)
    return found.select("learner", "feature", F.round("threshold", 6).alias("threshold"), "polarity", F.round("alpha", 6).alias("alpha"))


def _stump_sql(label: str, gradient: str, hessian: str, base: str, score: str, leaf: str, rate: float, valid: str, bins: int | None, link: str = "{0}") -> str:
    """One boosted stump: sums on both sides of each candidate, the first of the best, and the mean prediction of its sides."""
    parts = [f"with {LINES}", f"b as (select avg({label}) as mean from l)", f"r as (select q, d, t, {gradient} as g, {hessian} as h from l, b)", f"e as (select f, v, g, h from ({_LONG.format('r')}))"]
    if bins:
        share = ", ".join(str(i / bins) for i in range(1, bins))
        parts.append(f"k as (select distinct f, unnest(quantile_cont(v, [{share}])) as v, max(v) as top from e group by f), s as (select k.f, k.v, count(*) as ln, sum(g) as lg, sum(h) as lh from k join e on e.f = k.f and e.v <= k.v where k.v < top group by k.f, k.v)")
    else:
        parts.append("i as (select f, v, count(*) as n, sum(g) as g, sum(h) as h from e group by f, v), s as (select f, v, sum(n) over w as ln, sum(g) over w as lg, sum(h) over w as lh from i window w as (partition by f order by v rows unbounded preceding))")
    parts.append("a as (select count(*) as tn, sum(g) as tg, sum(h) as th from r)")
    parts.append("c as (select f, v, ln, lg, lh, tn - ln as rn, tg - lg as rg, th - lh as rh, tn, tg, th from s, a where ln < tn)")
    gain = " + ".join(score.format(x) for x in "lr") + " - " + score.format("t")
    parts.append(f"o as (select f, v, {leaf.format('l')} as lo, {leaf.format('r')} as hi from c where {valid} order by round({gain}, 9) desc, f, v limit 1)")
    parts.append(f"p as (select case when case f when 0 then q when 1 then d else t end <= v then 0 else 1 end as side, {base} + {rate} * case when case f when 0 then q when 1 then d else t end <= v then lo else hi end as m from l, o, b)")
    return ", ".join(parts) + f" select side, count(*) as n, round(avg({link.format('m')}), 5) as prediction from p group by side"


def _sides(spark, d, model: Boosting):
    rows = lines(spark, d)
    m = model.fit(rows)
    s = splits(m.trees[0])[0]
    side = F.when(F.col(m.features[s["feature"]]) <= s["threshold"], 0).otherwise(1).alias("side")
    return m.predict(rows).groupBy(side).agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 5).alias("prediction"))


@query(_stump_sql("label", "mean - label", "mean * (1 - mean)", "ln(mean / (1 - mean))", "0.5 * {0}g * {0}g / ({0}h + 1 + 1e-10)", "-{0}g / ({0}h + 1 + 1e-10)", 0.3, "lh >= 1 and rh >= 1", None, "1 / (1 + exp(-{0}))"))
def xgboost_stump(spark, d):
    return _sides(spark, d, Boosting.xgboost(["q", "d", "t"], n_estimators=1, max_depth=1, objective="logistic"))


@query(_stump_sql("price", "mean - price", "1.0", "mean", "0.5 * {0}g * {0}g / ({0}h + 1e-10)", "-{0}g / ({0}h + 1e-10)", 0.1, "ln >= 20 and rn >= 20", 16))
def lightgbm_stump(spark, d):
    return _sides(spark, d, Boosting.lightgbm(["q", "d", "t"], label="price", n_estimators=1, max_depth=1, max_bins=16))


@query(_stump_sql("price", "mean - price", "1.0", "mean", "{0}g * {0}g / ({0}n + 3)", "-{0}g / ({0}n + 3)", 0.03, "true", 16))
def catboost_stump(spark, d):
    return _sides(spark, d, Boosting.catboost(["q", "d", "t"], label="price", n_estimators=1, max_depth=1, max_bins=16))


@query("""with o as (select o_custkey as qid, o_orderkey as id, case when regexp_matches(o_orderpriority, '^[0-9]') then 5 - cast(substr(o_orderpriority, 1, 1) as int) else 0 end as rel from orders),
r as (select *, row_number() over (partition by qid order by id) as p, row_number() over (partition by qid order by rel desc, id) as b from o),
i as (select qid, sum((pow(2, rel) - 1) / log2(b + 1)) as ideal from r group by qid),
g as (select l.id as u, r.id as v, 0.5 * abs((pow(2, l.rel) - pow(2, r.rel)) * (1 / log2(l.p + 1) - 1 / log2(r.p + 1))) / ideal as g from r l join r using (qid) join i using (qid) where l.rel > r.rel and ideal > 0)
select id, round(sum(g), 6) as gradient from (select u as id, -g as g from g union all select v, g from g) group by id""")
def lambda_gradients(spark, d):
    found = LambdaRank(["price", "month"]).lambdas(_graded(spark, d).withColumn("m_", F.lit(0.0)))
    return found.select(F.col("k_").alias("id"), F.round("g_", 6).alias("gradient"))


@query("""with recursive o as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as t from events),
s as (select event_type, row_number() over (order by event_type) as i, count(*) over () as k from (select distinct event_type from events)),
e as (select user_id, t, 2.0::double * i / (k * (k + 1)) as ea, 2.0::double * (k + 1 - i) / (k * (k + 1)) as eb from o join s using (event_type)),
f as (select user_id, t, 0.6::double * ea as a, 0.4::double * eb as b, 0.6::double * ea as x, 0.4::double * eb as y from e where t = 1
union all select e.user_id, e.t, (f.a * 0.7 + f.b * 0.4) * ea, (f.a * 0.3 + f.b * 0.6) * eb, greatest(f.x * 0.7, f.y * 0.4) * ea, greatest(f.x * 0.3, f.y * 0.6) * eb from f join e on e.user_id = f.user_id and e.t = f.t + 1)
select user_id as seq_id, round(ln(a + b), 5) as log_likelihood, round(ln(greatest(x, y)), 5) as log_probability from f qualify row_number() over (partition by user_id order by t desc) = 1""")
def hidden_markov_forward(spark, d):
    events = read(spark, d, "events")
    symbols = sorted(r[0] for r in events.select("event_type").distinct().collect())
    k = len(symbols)
    rise = [2 * (i + 1) / (k * (k + 1)) for i in range(k)]
    m = HiddenMarkov(["a", "b"], symbols, [0.6, 0.4], [[0.7, 0.3], [0.4, 0.6]], [rise, rise[::-1]])
    seqs = sequences(events, "user_id", ["ts", "event_id"], "event_type")
    return m.score(seqs).select("seq_id", F.round("log_likelihood", 5).alias("log_likelihood")).join(m.predict(seqs).select("seq_id", F.round("log_probability", 5).alias("log_probability")), "seq_id")


@query("with o as (select cast(o_orderdate as date) as ds, sum(o_totalprice) as y from orders group by 1), t as (select date_diff('day', (select min(ds) from o), ds) as t, y from o) select round(regr_slope(y, t), 3) as slope, round(regr_intercept(y, t), 3) as intercept from t")
def trend(spark, d):
    daily = read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("ds")).agg(F.sum("o_totalprice").alias("y"))
    w = AdditiveForecast(0, yearly_seasonality=False, weekly_seasonality=False).fit(daily).weights
    return one(spark, slope=round(float(w[1]), 3), intercept=round(float(w[0]), 3))
