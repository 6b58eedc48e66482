"""Queries over the test tables, one or more for each estimator, with SQL where the result can be written in it.

Floating-point results are rounded on both sides, as engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.prepare import counted
from ..operators.clustering import Agglomerative, GaussianMixture, KMeans, NaiveBayes, NearestNeighbors
from ..operators.embedding import Autoencoder, IsolationForest, MatrixFactorization, Tsne, Umap
from ..operators.itemsets import Apriori
from ..operators.linear import AdditiveForecast, LeastSquares, LinearSvm, LogisticRegression, PrincipalComponents
from ..operators.sequences import HiddenMarkov, TopicModel
from ..operators.trees import AdaBoost, Boosting, DecisionTree, LambdaRank, RandomForest, splits
from ..sources.tables import baskets, read, sequences
from .factoring import rated
from .grown import adaboost_sql, boosted_sql, factorization_sql, forest_sql, oblivious_sql
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


def one(spark: SparkSession, **values) -> DataFrame:
    """A one-row result of a fitted model."""
    return spark.createDataFrame([tuple(values.values())], list(values))


@query(f"with {LINES} select round(regr_intercept(price, q), 5) as intercept, round(regr_slope(price, q), 5) as slope, round(regr_r2(price, q), 5) as r2 from l")
def ols_simple(spark, d):
    m = LeastSquares(["q"], "price").fit(lines(spark, d))
    return one(spark, intercept=round(m.intercept, 5), slope=round(m.get_coefficients()["slope"], 5), r2=round(m.score(lines(spark, d)), 5))


def _two(alpha: str) -> str:
    return f"""with {LINES}, s as (select count(*) as n, avg(q) as mq, avg(d) as md, avg(price) as my, var_pop(q) + {alpha} / count(*) as qq, var_pop(d) + {alpha} / count(*) as dd, covar_pop(q, d) as qd, covar_pop(q, price) as qy, covar_pop(d, price) as dy from l),
b as (select *, (dd * qy - qd * dy) / (qq * dd - qd * qd) as bq, (qq * dy - qd * qy) / (qq * dd - qd * qd) as bd from s)
select flag, round(avg(my + bq * (q - mq) + bd * (d - md)), 5) as prediction, count(*) as n from l, b group by flag"""


def _least_squares(spark, d, alpha):
    rows = lines(spark, d)
    m = LeastSquares(["q", "d"], "price", alpha).fit(rows)
    return m.predict(rows).groupBy("flag").agg(F.round(F.avg("prediction"), 5).alias("prediction"), F.count("*").alias("n"))


@query(_two("0"))
def ols_multiple(spark, d):
    return _least_squares(spark, d, 0.0)


@query(_two("100"))
def ridge(spark, d):
    return _least_squares(spark, d, 100.0)


def _steps(update: str, n: int = 3) -> str:
    out = [f"with {LINES}", "w0 as (select 0.0::double as b, 0.0::double as a, 0.0::double as c)"]
    return ", ".join([*out, *(f"w{k + 1} as ({update.format(w=f'w{k}')})" for k in range(n))]) + f" select round(b, 6) as intercept, round(a, 6) as w_q, round(c, 6) as w_d from w{n}"


@query(_steps("select any_value(b) - 0.5 * avg(p - label) as b, any_value(a) - 0.5 * avg((p - label) * q) as a, any_value(c) - 0.5 * avg((p - label) * d) as c from (select *, 1 / (1 + exp(-(b + a * q + c * d))) as p from l, {w})"))
def logistic_regression(spark, d):
    w = LogisticRegression(["q", "d"], learning_rate=0.5, iterations=3).fit(lines(spark, d)).weights
    return one(spark, **{k: round(float(x), 6) for k, x in zip(("intercept", "w_q", "w_d"), w)})


@query(_steps("select any_value(b) - 0.1 * avg(case when y * z < 1 then -y else 0 end) as b, any_value(a) - 0.1 * (0.02 * any_value(a) + avg(case when y * z < 1 then -y * q else 0 end)) as a, any_value(c) - 0.1 * (0.02 * any_value(c) + avg(case when y * z < 1 then -y * d else 0 end)) as c from (select *, b + a * q + c * d as z, 2 * label - 1 as y from l, {w})"))
def linear_svm(spark, d):
    m = LinearSvm(["q", "d"], learning_rate=0.1, iterations=3).fit(lines(spark, d))
    return one(spark, intercept=round(float(m.bias), 6), w_q=round(float(m.weights[0]), 6), w_d=round(float(m.weights[1]), 6))


@query("""with t as (select p_partkey as id, p_size / 50 as x, p_retailprice / 2000 as y, p_brand as label from part),
n as (select a.id, b.label, row_number() over (partition by a.id order by sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) as r from t a, t b where a.id % 100 = 0),
v as (select id, label, count(*) as votes from n where r <= 5 group by id, label)
select id, prediction from (select id, label as prediction, row_number() over (partition by id order by votes desc, label) as r from v) where r = 1""")
def nearest_neighbors(spark, d):
    t = read(spark, d, "part").selectExpr("p_partkey as id", "p_size / 50 as x", "p_retailprice / 2000 as y", "p_brand as label")
    return NearestNeighbors(["x", "y"]).fit(t).predict(t.where("id % 100 = 0")).select("id", "prediction")


@query(f"""with {LINES}, e as (select 0 as f, q as v, label from l union all select 1, d, label from l union all select 2, t, label from l),
g as (select f, v, count(*) as n, sum(label) as y from e group by f, v),
p as (select f, v, sum(n) over w as ln, sum(y) over w as ly, sum(n) over (partition by f) as tn, sum(y) over (partition by f) as ty from g window w as (partition by f order by v rows unbounded preceding)),
s as (select *, 2 * (ty / tn) * (1 - ty / tn) - ln / tn * 2 * (ly / ln) * (1 - ly / ln) - (tn - ln) / tn * 2 * ((ty - ly) / (tn - ln)) * (1 - (ty - ly) / (tn - ln)) as gain from p where ln < tn)
select cast(f as bigint) as feature, round(v, 6) as threshold, round(gain, 8) as gain from s order by round(gain, 12) desc, f, v limit 1""")
def tree_root_split(spark, d):
    root = DecisionTree(["q", "d", "t"], max_depth=1).fit(lines(spark, d)).tree[0]
    return one(spark, feature=int(root["feature"]), threshold=round(root["threshold"], 6), gain=round(root["gain"], 8))


@query(f"""with {LINES}, b as (select *, price - avg(price) over () as r from l),
e as (select 0 as f, q as v, r from b union all select 1, d, r from b),
g as (select f, v, count(*) as n, sum(r) as s from e group by f, v),
p as (select f, v, sum(n) over w as ln, sum(s) over w as ls, sum(n) over (partition by f) as tn, sum(s) over (partition by f) as ts from g window w as (partition by f order by v rows unbounded preceding)),
c as (select f, v, ls / ln as lo, (ts - ls) / (tn - ln) as hi from p where ln < tn order by ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) desc, f, v limit 1)
select case when case when f = 0 then q else d end <= v then 0 else 1 end as side, count(*) as n, round(avg((select avg(price) from l) + 0.1 * case when case when f = 0 then q else d end <= v then lo else hi end), 5) as prediction from l, c group by 1""")
def gradient_boosting_stump(spark, d):
    rows = lines(spark, d)
    m = Boosting(["q", "d"], "price", n_estimators=1, max_depth=1).fit(rows)
    s = splits(m.trees[0])[0]
    side = F.when(F.col(m.features[s["feature"]]) <= s["threshold"], 0).otherwise(1).alias("side")
    return m.predict(rows).groupBy(side).agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 5).alias("prediction"))


def _boosted(name: str, model, sql: str) -> None:
    def run(spark, d):
        rows = lines(spark, d)
        m = model().fit(rows)
        return m.predict(rows).groupBy("flag").agg(F.round(F.avg("prediction"), 4).alias("prediction"), F.count("*").alias("n"))

    run.__name__ = name
    query(sql)(run)


_NEWTON = "0.5 * (l_g * l_g / (l_h + {r} + 1e-10) + r_g * r_g / (r_h + {r} + 1e-10) - t_g * t_g / (t_h + {r} + 1e-10))"
_boosted("gradient_boosting", lambda: Boosting(["q", "d", "t"], "price", n_estimators=3), boosted_sql("price", 256, 3, 3, 0.1, "mean", "m - price", "1.0", "(l_g * l_g / l_n + r_g * r_g / r_n - t_g * t_g / t_n) / t_n", "l_n >= 1 and r_n >= 1", "-sum(g) / sum(n)"))
_boosted("xgboost", lambda: Boosting.xgboost(["q", "d", "t"], n_estimators=3, max_depth=3, objective="logistic"), boosted_sql("label", 256, 3, 3, 0.3, "ln(mean / (1 - mean))", "1 / (1 + exp(-m)) - label", "1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m)))", _NEWTON.format(r="1"), "l_n >= 1 and r_n >= 1 and l_h >= 1 and r_h >= 1", "-sum(g) / (sum(h) + 1 + 1e-10)", "1 / (1 + exp(-m))"))
_boosted("lightgbm", lambda: Boosting.lightgbm(["q", "d", "t"], n_estimators=3, max_depth=3, max_bins=32, label="price"), boosted_sql("price", 32, 3, 3, 0.1, "mean", "m - price", "1.0", _NEWTON.format(r="0"), "l_n >= 20 and r_n >= 20", "-sum(g) / (sum(h) + 1e-10)"))
_boosted("catboost", lambda: Boosting.catboost(["q", "d", "t"], n_estimators=3, max_depth=3, max_bins=16, label="price"), oblivious_sql("price", 16, 3, 3, 0.03, 3))


@query(forest_sql(3, 3, 16))
def random_forest(spark, d):
    rows = lines(spark, d)
    m = RandomForest(["q", "d", "t"], "flag", n_estimators=3, max_depth=3, max_bins=16).fit(rows)
    return metrics.confusion(m.predict(rows), "flag", "prediction").toDF("actual", "predicted", "n")


@query(adaboost_sql(3, 16))
def adaboost(spark, d):
    rows = lines(spark, d).withColumn("label", F.expr("case when label = 1 then 1 else -1 end"))
    found = AdaBoost(["q", "d", "t"], n_estimators=3, max_bins=16).fit(rows).learners(spark)
    return found.select("learner", "feature", F.round("threshold", 6).alias("threshold"), "polarity", F.round("alpha", 6).alias("alpha"))


@query(f"with {LINES} select flag, round(count(*) / (select count(*) from l), 6) as prior, round(avg(q), 6) as mean_q, round(var_pop(q) + 1e-9, 6) as var_q, round(avg(price), 6) as mean_price, round(var_pop(price) + 1e-9, 6) as var_price from l group by flag")
def naive_bayes(spark, d):
    m = NaiveBayes(["q", "price"], "flag").fit(lines(spark, d))
    rows = [(c, *(round(float(x), 6) for x in (p, mu[0], v[0], mu[1], v[1]))) for c, p, mu, v in zip(m.classes, m.priors, m.means, m.variances)]
    return spark.createDataFrame(rows, "flag string, prior double, mean_q double, var_q double, mean_price double, var_price double")


_K = [(0.2, 1.0), (0.5, 3.0), (0.9, 6.0)]


def _kmeans_sql(n: int = 3) -> str:
    out = [f"with {LINES}", "c0 as (" + " union all ".join(f"select {k} as k, {a}::double as a, {b}::double as b" for k, (a, b) in enumerate(_K)) + ")"]
    for i in range(n):
        out.append(f"a{i} as (select id, q, price, arg_min(k, (q - a) * (q - a) + (price - b) * (price - b)) as k from l, c{i} group by id, q, price), c{i + 1} as (select k, avg(q) as a, avg(price) as b from a{i} group by k)")
    return ", ".join(out) + f" select k as cluster, round(a, 6) as q, round(b, 6) as price from c{n}"


@query(_kmeans_sql())
def kmeans(spark, d):
    m = KMeans(["q", "price"], max_iter=3, tol=0, initial=[list(c) for c in _K]).fit(lines(spark, d))
    return spark.createDataFrame([(k, round(float(a), 6), round(float(b), 6)) for k, (a, b) in enumerate(m.centers)], "cluster int, q double, price double")


@query(f"with {LINES}, s as (select var_samp(q) as a, var_samp(price) as b, covar_samp(q, price) as c from l) select round((a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c), 6) as first, round((a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c), 6) as second from s")
def principal_components(spark, d):
    v = PrincipalComponents(["q", "price"]).fit(lines(spark, d)).explained_variance
    return one(spark, first=round(float(v[0]), 6), second=round(float(v[1]), 6))


@query(f"""with {LINES}, p as (select price, exp(-0.5 * (price - 2) * (price - 2)) as a, exp(-0.5 * (price - 6) * (price - 6)) as b from l),
r as (select price, a / (a + b) as a, b / (a + b) as b from p)
select round(avg(a), 6) as weight_0, round(avg(b), 6) as weight_1, round(sum(a * price) / sum(a), 6) as mean_0, round(sum(b * price) / sum(b), 6) as mean_1 from r""")
def gaussian_mixture(spark, d):
    m = GaussianMixture(["price"], 2, max_iter=1, initial_means=[[2.0], [6.0]]).fit(lines(spark, d))
    return one(spark, weight_0=round(float(m.weights[0]), 6), weight_1=round(float(m.weights[1]), 6), mean_0=round(float(m.means[0, 0]), 6), mean_1=round(float(m.means[1, 0]), 6))


_BASKETS = "b as (select distinct o_custkey as tid, o_orderpriority as item from orders), n as (select count(distinct tid) as n from b), s1 as (select item, count(*) as c from b group by item having count(*) >= 0.05 * (select n from n)), s2 as (select x.item as i, y.item as j, count(*) as c from b x join b y on x.tid = y.tid and x.item < y.item group by x.item, y.item having count(*) >= 0.05 * (select n from n))"


def _apriori(spark, d, confidence=0.6):
    return Apriori(0.05, confidence, max_size=2).fit(baskets(read(spark, d, "orders"), "o_custkey", "o_orderpriority"))


@query(f"with {_BASKETS} select item as items, round(c / n, 6) as support from s1, n union all select i || '|' || j, round(c / n, 6) from s2, n")
def frequent_itemsets(spark, d):
    return _apriori(spark, d).itemsets.select(F.array_join("items", "|").alias("items"), F.round("support", 6).alias("support"))


@query(f"with {_BASKETS}, r as (select i as a, j as b, c from s2 union all select j, i, c from s2) select a as antecedent, b as consequent, round(r.c / n, 5) as support, round(r.c / x.c, 5) as confidence, round(r.c / n / ((x.c / n) * (y.c / n)), 5) as lift from r, n, s1 x, s1 y where x.item = a and y.item = b and r.c / x.c >= 0.6 - 1e-9")
def association_rules(spark, d):
    return _apriori(spark, d).generate_rules().select(F.col("antecedent")[0].alias("antecedent"), F.col("consequent")[0].alias("consequent"), *[F.round(c, 5).alias(c) for c in ("support", "confidence", "lift")])


@query("""with o as (select o_custkey as qid, o_orderkey as id, 5 - cast(substr(o_orderpriority, 1, 1) as int) as rel, o_totalprice as score from orders),
r as (select qid, rel, row_number() over (partition by qid order by score desc, id) as p, row_number() over (partition by qid order by rel desc, id) as b from o)
select qid, case when sum((pow(2, rel) - 1) / log2(b + 1)) = 0 then 0.0 else round(sum(case when p <= 10 then (pow(2, rel) - 1) / log2(p + 1) else 0 end) / sum(case when b <= 10 then (pow(2, rel) - 1) / log2(b + 1) else 0 end), 6) end as ndcg from r group by qid""")
def ndcg_at_10(spark, d):
    return metrics.ndcg(_graded(spark, d), "qid", "rel", "score", "id", 10).select("qid", F.round("ndcg", 6).alias("ndcg"))


def _graded(spark, d):
    return read(spark, d, "orders").selectExpr("o_custkey as qid", "o_orderkey as id", "case when o_orderpriority rlike '^[0-9]' then 5 - cast(substr(o_orderpriority, 1, 1) as int) else 0 end as rel", "o_totalprice as score", "o_totalprice / 100000 as price", "month(o_orderdate) as month")


@query("""with o as (select o_custkey as qid, o_orderkey as id, case when substr(o_orderpriority, 1, 1) in ('1', '2') then 1 else 0 end as rel, o_totalprice as score from orders),
r as (select qid, rel, row_number() over w as p, sum(rel) over (w rows unbounded preceding) as h from o window w as (partition by qid order by score desc, id))
select qid, round(coalesce(sum(rel * h / p) / nullif(sum(rel), 0), 0), 6) as average_precision, round(coalesce(1 / min(case when rel = 1 then p end), 0), 6) as reciprocal_rank, round(sum(case when p <= 5 then rel else 0 end) / 5, 6) as precision_at_k, round(coalesce(sum(case when p <= 5 then rel else 0 end) / nullif(sum(rel), 0), 0), 6) as recall_at_k from r group by qid""")
def ranking_metrics(spark, d):
    rows = read(spark, d, "orders").selectExpr("o_custkey as qid", "o_orderkey as id", "case when substr(o_orderpriority, 1, 1) in ('1', '2') then 1 else 0 end as rel", "o_totalprice as score")
    return metrics.ranking(rows, "qid", "rel", "score", "id", 5).select("qid", *[F.round(c, 6).alias(c) for c in ("average_precision", "reciprocal_rank", "precision_at_k", "recall_at_k")])


@query("select event_id, round((coalesce(sum(case when value > 50 then 1 else 0 end) over w, 0) + 0.5) / (count(*) over w + 1), 6) as target_statistic from events window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)")
def ordered_target_statistic(spark, d):
    rows = read(spark, d, "events").selectExpr("event_id", "user_id", "case when value > 50 then 1 else 0 end as y")
    return metrics.ordered_target_statistic(rows, "user_id", "y", "event_id").select("event_id", F.round("target_statistic", 6).alias("target_statistic"))


@query(f"with {LINES}, p as (select label, case when q > 0.5 then 1 else 0 end as p from l), c as (select sum(label * p) as tp, sum((1 - label) * p) as fp, sum(label * (1 - p)) as fn from p) select cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c")
def precision_recall(spark, d):
    p = metrics.precision_recall(lines(spark, d).withColumn("prediction", F.expr("case when q > 0.5 then 1 else 0 end")))
    return p.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query()
def additive_forecast(spark, d):
    daily = read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("ds")).agg(F.sum("o_totalprice").alias("y"))
    m = AdditiveForecast(5, yearly_fourier_order=3).fit(daily)
    return m.get_components(m.make_future_dataframe(spark, 30)).select("ds", *[F.round(c, 2).alias(c) for c in ("trend", "yearly", "weekly", "yhat")])


@query()
def hidden_markov(spark, d):
    seqs = sequences(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    symbols = sorted(r[0] for r in read(spark, d, "events").select("event_type").distinct().collect())
    m = HiddenMarkov(["a", "b"], symbols).fit(seqs, 3)
    return m.score(seqs).select("seq_id", F.round("log_likelihood", 4).alias("log_likelihood")).join(m.predict(seqs).select("seq_id", F.size("path").alias("steps")), "seq_id")


@query()
def isolation_forest(spark, d):
    rows = read(spark, d, "events").selectExpr("event_id as id", "value", "hour(ts) as hour")
    return IsolationForest(["value", "hour"], n_estimators=20).fit(rows).predict(rows).groupBy("prediction").agg(F.count("*").alias("n"))


@query(factorization_sql(3, 3, 0.01, 1.0, top=3))
def matrix_factorization(spark, d):
    m = MatrixFactorization(3, n_epochs=3).fit(rated(spark, d))
    return m.recommend(m.users, 3).select("user", "item", "rank")


@query()
def topic_model(spark, d):
    words = F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ")
    counts = counted(read(spark, d, "documents").withColumnRenamed("doc_id", "doc"), "doc", words, shortest=3)
    return TopicModel(4, max_iter=2).fit(counts).get_top_words(5).select("topic", "rank", "term")


def _suppliers(spark, d):
    return read(spark, d, "supplier").selectExpr("s_suppkey as id", "s_acctbal / 1000 as balance", "cast(s_nationkey as double) as nation")


@query()
def agglomerative(spark, d):
    return Agglomerative(["balance", "nation"], 4).fit_predict(_suppliers(spark, d)).select("id", "cluster")


@query()
def tsne(spark, d):
    return Tsne(["balance", "nation"], perplexity=10, n_iter=3).fit_transform(_suppliers(spark, d)).select("id", *[F.round(c, 7).alias(c) for c in ("y_0", "y_1")])


@query()
def tsne_cells(spark, d):
    """Customers, by a quadtree: three times the rows that the table of pairs takes at sf0.1."""
    rows = read(spark, d, "customer").selectExpr("c_custkey as id", "c_acctbal / 1000 as balance", "cast(c_nationkey as double) as nation")
    return Tsne(["balance", "nation"], perplexity=10, n_iter=2, theta=0.5).fit_transform(rows).select("id", *[F.round(c, 7).alias(c) for c in ("y_0", "y_1")])


@query()
def umap(spark, d):
    return Umap(["balance", "nation"], n_neighbors=8, n_epochs=3).fit_transform(_suppliers(spark, d)).select("id", *[F.round(c, 5).alias(c) for c in ("y_0", "y_1")])


@query()
def autoencoder(spark, d):
    rows = lines(spark, d)
    return Autoencoder(["q", "d", "t"], 2, epochs=3, activation="tanh").fit(rows).reconstruction_error(rows).groupBy("flag").agg(F.round(F.avg("error"), 4).alias("error"))


@query()
def lambda_rank(spark, d):
    rows = _graded(spark, d)
    return LambdaRank(["price", "month"], n_estimators=2, max_depth=2, max_bins=16).fit(rows).evaluate(rows).select("qid", F.round("ndcg", 6).alias("ndcg"))
