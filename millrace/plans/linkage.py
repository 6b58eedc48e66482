"""Single linkage of suppliers by a spanning tree (the SQL grows it a point a step), and neighbours of customers by descent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.descent import neighbour_descent
from ..operators.spanning import SingleLinkage
from ..sources.tables import read
from .estimators import _suppliers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_TREE = """with recursive s as (select s_suppkey as id, s_acctbal / 1000 as x, s_nationkey::double as y from supplier),
p as materialized (select a.id as i, b.id as j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from s a join s b on a.id <> b.id),
t as (select [min(id)] as seen, null::bigint as i, null::bigint as j, null::double as d, 0 as step from s
      union all
      select list_append(any_value(t.seen), arg_min(p.j, p.d)), arg_min(p.i, p.d)::bigint, arg_min(p.j, p.d)::bigint, min(p.d), t.step + 1
      from t join p on list_contains(t.seen, p.i) and not list_contains(t.seen, p.j) group by t.step),
e as materialized (select least(i, j) as lo, greatest(i, j) as hi, d from t where i is not null)"""


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


@query(_TREE + " select cast(row_number() over (order by d, lo, hi) as bigint) as step, lo::bigint as lo, hi::bigint as hi, round(d, 6) as d from e")
def spanning_tree(spark, d):
    """All merges of single linkage, by distance."""
    return SingleLinkage(["balance", "nation"]).fit(_suppliers(spark, d)).merges().select("step", "lo", "hi", F.round("d", 6).alias("d"))


@query(
    _TREE
    + """, k as (select lo, hi from (select *, row_number() over (order by d desc, lo desc, hi desc) as n from e) where n > 7),
w as (select id as a, id as b from s union select w.a, case when k.lo = w.b then k.hi else k.lo end from w join k on k.lo = w.b or k.hi = w.b),
c as (select a as id, min(b) as least from w group by a) select id::bigint as id, cast(dense_rank() over (order by least) - 1 as int) as cluster from c"""
)
def single_linkage(spark, d):
    """Eight clusters of suppliers."""
    return SingleLinkage(["balance", "nation"], 8).fit_predict(_suppliers(spark, d)).select(F.col("id").cast("long").alias("id"), "cluster")


def descent_neighbours(spark, d):
    """Each customer's five nearest by descent: how far the nearest and the farthest of them are."""
    rows = read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("i"), F.expr("array(c_acctbal / 1000, cast(c_nationkey as double))").alias("x"))
    return neighbour_descent(rows, 5).groupBy(F.col("i").alias("id")).agg(F.count("*").alias("n"), F.round(F.min("d"), 6).alias("nearest"), F.round(F.max("d"), 6).alias("farthest"))


QUERIES["descent_neighbours"] = descent_neighbours
