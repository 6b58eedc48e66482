"""Queries of preparation, validation, sampling and re-ranking over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, prepare
from ..operators import ranking
from ..operators.clustering import NearestNeighbors
from ..operators.linear import AdditiveForecast, LeastSquares
from ..operators.loop import written
from ..sources.tables import read
from .estimators import one
from .lines import LINES, lines

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# DuckDB's text of prepare.draw.
DRAW = "(('0x' || substr(md5('{seed}:' || {key}::varchar), 1, 8))::bigint / 4294967296.0)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(f"with {LINES} select flag, round(avg((q - mq) / sq), 6) as q_scaled, round(avg((price - lo) / (hi - lo)), 6) as price_scaled from l, (select avg(q) as mq, stddev_pop(q) as sq, min(price) as lo, max(price) as hi from l) group by flag")
def scaling(spark, d):
    out = prepare.scale(prepare.scale(lines(spark, d), ["q"]), ["price"], "minmax")
    return out.groupBy("flag").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("q_scaled", "price_scaled")])


_GRID = [-0.5, 0.0, 0.5, 1.0, 1.5]


def _likelihoods() -> str:
    parts = []
    for g in _GRID:
        y = f"case when x >= 0 then {'ln(x + 1)' if g == 0 else f'(pow(x + 1, {g}) - 1) / {g}'} else -((pow(1 - x, {2 - g}) - 1) / {2 - g}) end"
        parts.append(f"select {g}::double as exponent, -0.5 * count(x) * ln(var_pop({y})) + ({g} - 1) * sum(sign(x) * ln(abs(x) + 1)) as fit from c")
    return " union all ".join(parts)


@query(f"with c as (select c_acctbal / 1000 as x from customer), g as ({_likelihoods()}), b as (select exponent from g order by fit desc, exponent limit 1) select exponent, round(avg(case when x >= 0 then case when exponent = 0 then ln(x + 1) else (pow(x + 1, exponent) - 1) / exponent end else -((pow(1 - x, 2 - exponent) - 1) / (2 - exponent)) end), 5) as mean from c, b group by exponent")
def power_transform(spark, d):
    rows = read(spark, d, "customer").selectExpr("c_acctbal / 1000 as x")
    g = prepare.power_exponent(rows, "x", grid=_GRID)
    return rows.agg(F.lit(g).alias("exponent"), F.round(F.avg(F.expr(prepare.power("x", g))), 5).alias("mean"))


@query(f"""with {LINES}, e as (select 'q' as feature, q as x, flag from l union all select 'd', d, flag from l union all select 't', t, flag from l),
c as (select feature, flag, sum(x) as seen, count(*) as n from e group by feature, flag), w as (select *, sum(seen) over (partition by feature) * n / sum(n) over (partition by feature) as due from c)
select feature, round(sum((seen - due) * (seen - due) / due), 5) as statistic from w group by feature""")
def chi_square(spark, d):
    return prepare.chi_square(lines(spark, d), ["q", "d", "t"], "flag").select("feature", F.round("statistic", 5).alias("statistic"))


@query("select p_brand, cast(dense_rank() over (order by p_brand) - 1 as int) as p_brand_code, count(*) as n from part group by p_brand")
def label_encoding(spark, d):
    return prepare.label_encode(read(spark, d, "part"), "p_brand").groupBy("p_brand", "p_brand_code").agg(F.count("*").alias("n"))


@query("select l_linestatus, count(*) filter (where l_returnflag = 'A') as n_a, count(*) filter (where l_returnflag = 'N') as n_n, count(*) filter (where l_returnflag = 'R') as n_r from lineitem group by l_linestatus")
def one_hot(spark, d):
    out = prepare.one_hot(read(spark, d, "lineitem").select("l_linestatus", "l_returnflag"), "l_returnflag")
    return out.groupBy("l_linestatus").agg(*[F.sum(f"l_returnflag_{v}").alias(f"n_{v.lower()}") for v in "ANR"])


_TERMS = r"""w as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), 'http\S+', '', 'g'), '[^a-z\s]', '', 'g'), '\s+'), lambda x: x <> '') as w from documents),
t as (select doc_id, unnest(w) as term from w union all select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w), c as (select doc_id, term, count(*) as cnt from t group by doc_id, term)"""


@query(f"with {_TERMS} select term, count(*) as df, cast(sum(cnt) as bigint) as cnt from c group by term having count(*) >= 5 and count(*) <= 0.5 * (select count(*) from documents) order by 3 desc, 1 limit 200")
def term_vocabulary(spark, d):
    docs = read(spark, d, "documents")
    return prepare.vocabulary(prepare.terms(docs, "doc_id", "text", 2), "doc_id", docs.count(), 5, 0.5, 200)


def _top_words(counts):
    by_lang = counts.where("length(term) >= 4").select("term", F.explode("lang").alias("topic")).groupBy("topic", "term").agg(F.count("*").alias("n"))
    return ranking.ranked(by_lang, "topic", "n", "term").where("position < 8")


@query(f"""with {_TERMS.replace(" union all select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w", "")},
n as (select lang as topic, term, count(*) as n from c join documents using (doc_id) where length(term) >= 4 and lang is not null group by 1, 2),
top as (select topic, term from n qualify row_number() over (partition by topic order by n desc, term) <= 8),
s as (select term, count(*) as n from c group by term), total as (select count(distinct doc_id)::double as n from c),
p as (select x.topic, x.term as a, y.term as b from top x join top y on x.topic = y.topic and x.term < y.term),
u as (select distinct a, b from p), m as (select u.a, u.b, count(*) as n from u join c x on x.term = u.a join c y on y.term = u.b and x.doc_id = y.doc_id group by 1, 2)
select topic, round(avg(case when m.n is null then -1 when m.n >= total.n then 1 else ln((m.n / total.n) / ((sa.n / total.n) * (sb.n / total.n))) / -ln(m.n / total.n) end), 5) as coherence
from p join s sa on sa.term = a join s sb on sb.term = b left join m on m.a = p.a and m.b = p.b, total group by topic""")
def topic_coherence(spark, d):
    docs = read(spark, d, "documents")
    counts = written(prepare.terms(docs, "doc_id", "text", beside="lang").withColumnRenamed("doc_id", "doc"))
    return ranking.coherence(counts, _top_words(counts)).select("topic", F.round("coherence", 5).alias("coherence"))


@query(f"select cast(floor({DRAW.format(seed=7, key='o_orderkey')} * 5) as int) as fold, count(*) as n from orders group by 1")
def fold_split(spark, d):
    return prepare.folds(read(spark, d, "orders"), "o_orderkey", 5, 7).groupBy("fold").agg(F.count("*").alias("n"))


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) <= floor(count(*) over (partition by o_custkey) * 0.2) as is_test from orders")
def customer_split(spark, d):
    return prepare.split_groups(read(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "is_test")


@query(f"""with g as (select o_orderkey as id, o_totalprice - 150000 as g from orders), c as (select quantile_disc(abs(g), 0.8) as cut from g)
select case when abs(g) >= cut then 1.0::double else 0.8 / 0.1::double end as weight, count(*) as n from g, c where abs(g) >= cut or {DRAW.format(seed=0, key='id')} < 0.1 / 0.8 group by 1""")
def gradient_sample(spark, d):
    rows = read(spark, d, "orders").selectExpr("o_orderkey as id", "o_totalprice - 150000 as g")
    return prepare.goss(rows, "g", "id").groupBy("weight").agg(F.count("*").alias("n"))


@query(f"""with {LINES}, s as (select regr_slope(price, q) as b, regr_intercept(price, q) as a, regr_sxx(price, q) as sxx, avg(q) as m, count(*) as n, (regr_syy(price, q) - regr_slope(price, q) * regr_sxy(price, q)) / (count(*) - 2) as v from l)
select round(q, 4) as q, count(*) as n, round(avg(a + b * q - 1.96 * sqrt(v * (1 + 1 / s.n + (q - m) * (q - m) / sxx))), 4) as lower, round(avg(a + b * q + 1.96 * sqrt(v * (1 + 1 / s.n + (q - m) * (q - m) / sxx))), 4) as upper from l, s group by 1""")
def prediction_interval(spark, d):
    rows = lines(spark, d)
    out = LeastSquares(["q"], "price").fit(rows).interval(rows)
    return out.groupBy(F.round("q", 4).alias("q")).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("lower", "upper")])


@query()
def forecast_validation(spark, d):
    daily = read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("ds")).agg(F.sum("o_totalprice").alias("y"))
    found = AdditiveForecast(3, yearly_fourier_order=2).cross_validate(daily, 3)
    return spark.createDataFrame([(i, n, None if e is None else round(e, 2)) for i, (n, e) in enumerate(found)], "fold int, n_train long, mae double")


_SIMILAR = "(a.x * b.x + a.y * b.y) / (sqrt(a.x * a.x + a.y * a.y) * sqrt(b.x * b.x + b.y * b.y) + 1e-10)"


@query(f"""with p as (select p_brand as brand, p_partkey as id, p_retailprice / 2000 as s, p_size / 50 as x, p_retailprice / 2000 as y from part),
r1 as (select * from p qualify row_number() over (partition by brand order by s desc, id) = 1),
n1 as (select a.*, {_SIMILAR} as near from p a join r1 b using (brand) where a.id <> b.id),
r2 as (select * from n1 qualify row_number() over (partition by brand order by 0.5 * s - 0.5 * near desc, id) = 1),
n2 as (select a.brand, a.id, a.s, greatest(a.near, {_SIMILAR}) as near from n1 a join r2 b using (brand) where a.id <> b.id),
r3 as (select * from n2 qualify row_number() over (partition by brand order by 0.5 * s - 0.5 * near desc, id) = 1)
select brand, id, 1 as rank from r1 union all select brand, id, 2 from r2 union all select brand, id, 3 from r3""")
def diversified_ranking(spark, d):
    rows = read(spark, d, "part").selectExpr("p_brand as brand", "p_partkey as id", "p_retailprice / 2000 as score", "array(cast(p_size / 50 as double), cast(p_retailprice / 2000 as double)) as v")
    return ranking.diversify(rows, "brand", "id", "score", "v", 3)


@query("with r as (select o_custkey as qid, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) - 1 as p, case when substr(o_orderpriority, 1, 1) = '1' then 1 else 0 end as y from orders) select qid, round(sum(y * log2(p + 2)), 5) as adjusted_clicks from r group by qid")
def position_bias(spark, d):
    rows = read(spark, d, "orders").selectExpr("o_custkey as qid", "o_orderkey as id", "o_totalprice as score", "case when substr(o_orderpriority, 1, 1) = '1' then 1 else 0 end as y")
    return ranking.position_weights(ranking.ranked(rows, "qid", "score", "id"), "y", "position").groupBy("qid").agg(F.round(F.sum("adjusted_clicks"), 5).alias("adjusted_clicks"))


@query("""with t as (select p_partkey as id, p_size / 50 as x, p_retailprice / 2000 as y, p_brand as label from part),
n as (select a.id, b.label, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as dist, b.id as tid from t a, t b where a.id % 100 = 0),
r as (select *, row_number() over (partition by id order by dist, tid) as r from n), v as (select id, label, sum(1 / (dist + 1e-10)) as votes from r where r <= 5 group by id, label)
select id, label as prediction from v qualify row_number() over (partition by id order by votes desc, label) = 1""")
def weighted_neighbors(spark, d):
    t = read(spark, d, "part").selectExpr("p_partkey as id", "p_size / 50 as x", "p_retailprice / 2000 as y", "p_brand as label")
    return NearestNeighbors(["x", "y"], weights="distance").fit(t).predict(t.where("id % 100 = 0")).select("id", "prediction")


@query(f"with {LINES}, v as (select price, sum(case when label = 0 then 1 else 0 end) as x, sum(label) as y from l group by price), c as (select abs(sum(x) over w / sum(x) over () - sum(y) over w / sum(y) over ()) as d from v window w as (order by price)) select round(max(d), 6) as distance from c")
def two_sample_ks(spark, d):
    return one(spark, distance=round(metrics.two_sample_ks(lines(spark, d), "price", "label"), 6))


@query(f"""with {LINES}, k as (select row_number() over () as id, q, price, case when q <= 0.3 then 0 when q <= 0.7 then 1 else 2 end as k from l), c as (select k, avg(q) as a, avg(price) as b from k group by k),
d as (select id, min(case when k.k = c.k then sqrt((q - a) * (q - a) + (price - b) * (price - b)) end) as a, min(case when k.k <> c.k then sqrt((q - a) * (q - a) + (price - b) * (price - b)) end) as b from k, c group by id)
select round(avg((b - a) / greatest(a, b)), 5) as silhouette from d""")
def silhouette(spark, d):
    rows = lines(spark, d).withColumn("k", F.expr("case when q <= 0.3 then 0 when q <= 0.7 then 1 else 2 end"))
    return one(spark, silhouette=round(metrics.silhouette(rows, ["q", "price"], "k"), 5))


@query(f"""with {LINES}, c as (select flag, status, count(*)::double as n from l group by flag, status), t as (select sum(n) as n, sum(n * (n - 1) / 2) as same from c),
a as (select sum(n * (n - 1) / 2) as p from (select sum(n) as n from c group by flag)), b as (select sum(n * (n - 1) / 2) as p from (select sum(n) as n from c group by status)),
e as (select same, a.p as a, b.p as b, a.p * b.p / (n * (n - 1) / 2) as e from t, a, b) select round((same - e) / ((a + b) / 2 - e), 6) as adjusted_rand from e""")
def adjusted_rand(spark, d):
    return one(spark, adjusted_rand=round(metrics.adjusted_rand(lines(spark, d), "flag", "status"), 6))
