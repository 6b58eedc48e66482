"""Ordered boosting, bundled features and models that are written, read and added to; with SQL that follows whole fits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.loop import shared_dir
from ..operators.ordered_boosting import OrderedBoosting
from ..operators.trees import Boosting
from ..sources.models import load, save
from .grown import cuts_sql, grow_sql, ordered_sql
from .lines import LINES, lines

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


@query(ordered_sql("label", 16, 2, 2, 0.3, 3.0, 0.5))
def ordered_boosting(spark, d):
    """Mean margins of each block of the random order: by the model of the earlier rows, and by that of all rows."""
    rows = lines(spark, d)
    m = OrderedBoosting(["q", "d", "t"], ["status"], objective="logistic", n_estimators=2, learning_rate=0.3, max_depth=2, max_bins=16).fit(rows)
    return m.margins.groupBy(F.col("block").cast("long").alias("block")).agg(F.count("*").alias("n"), F.round(F.avg("margin"), 5).alias("margin"), F.round(F.avg("last"), 5).alias("last_margin"))


_GAIN = "0.5 * (l_g * l_g / (l_h + {0} + 1e-10) + r_g * r_g / (r_h + {0} + 1e-10) - t_g * t_g / (t_h + {0} + 1e-10))"


def _round_sql(name: str, rows: str, label: str, width: int, depth: int, rate: float, ridge: float, valid: str) -> list[str]:
    """CTEs of a tree for squared loss on rows (b0..., m): {name}_v, its leaves by node, and {name}m, the rows with new m."""
    return [
        f"{name}r as materialized (select *, 1.0::double as n, m - {label} as g, 1.0::double as h from {rows})",
        *grow_sql(name, f"{name}r", ["n", "g", "h"], _GAIN.format(ridge), valid, depth, "1e-12", "t_n >= 2", width),
        f"{name}v as (select node, -sum(g) / (sum(h) + {ridge} + 1e-10) as leaf from {name}_{depth} group by node)",
        f"{name}m as materialized (select t.* exclude (node, n, g, h, m, leaf), m + {rate} * leaf as m from (select * from {name}_{depth} join {name}v using (node)) t)",
    ]


def _bundled_sql(rounds: int) -> str:
    features = ("q", "fa", "fn", "fr", "so", "sf")
    one = ", ".join(f"({c} = '{v}')::int::double as {n}" for c, v, n in (("flag", "A", "fa"), ("flag", "N", "fn"), ("flag", "R", "fr"), ("status", "O", "so"), ("status", "F", "sf")))
    out = [f"with {LINES}", f"o as materialized (select *, {one} from l)", *cuts_sql(255, features, "o"), "s0m as materialized (select x.*, (select avg(price) from o) as m from x)"]
    for k in range(rounds):
        out += _round_sql(f"s{k + 1}", f"s{k}m", "price", len(features), 3, 0.1, 0.0, "l_n >= 20 and r_n >= 20")
    return ", ".join(out) + f" select flag, status, round(avg(m), 5) as prediction, count(*) as n from s{rounds}m group by 1, 2"


@query(_bundled_sql(2))
def bundled_boosting(spark, d):
    """Mean predictions of boosted trees on one-hot columns, which share the entries of the histograms."""
    rows = lines(spark, d)
    for c, values in (("flag", "ANR"), ("status", "OF")):
        rows = rows.withColumns({f"{c[0]}{v.lower()}": (F.col(c) == v).cast("double") for v in values})
    m = Boosting.lightgbm(["q", "fa", "fn", "fr", "so", "sf"], label="price", n_estimators=2, learning_rate=0.1, max_depth=3, bundle=True).fit(rows)
    return m.predict(rows).groupBy("flag", "status").agg(F.round(F.avg("prediction"), 5).alias("prediction"), F.count("*").alias("n"))


def _updated_sql(first: int, more: int) -> str:
    """Trees on the older half of the lines, then trees on the rest, whose margins come from the first ones' thresholds."""
    features = ("q", "d", "t")
    out = [f"with {LINES}", "o as materialized (select * from l where id % 2 = 0)", *cuts_sql(64, features, "o"), "mean as (select avg(price) as m from o)", "s0m as materialized (select x.*, mean.m from x, mean)"]
    for k in range(first):
        out += _round_sql(f"s{k + 1}", f"s{k}m", "price", 3, 2, 0.3, 1.0, "l_n >= 1 and r_n >= 1 and l_h >= 1 and r_h >= 1")
    out.append("u0 as materialized (select l.*, mean.m from l, mean where id % 2 <> 0)")
    for k in range(first):
        # The way of new rows through tree k, split by split.
        out.append(f"w{k}_0 as materialized (select *, 0 as node from u{k})")
        for j in range(2):
            out.append(f"w{k}_{j + 1} as materialized (select w.* exclude (node), case when c.node is null then w.node when case c.f when 0 then q when 1 then d else t end <= c.v then 2 * w.node + 1 else 2 * w.node + 2 end as node from w{k}_{j} w left join s{k + 1}_{j}b c on c.node = w.node)")
        out.append(f"u{k + 1} as materialized (select w.* exclude (node, m), m + 0.3 * coalesce(leaf, 0) as m from w{k}_2 w left join s{k + 1}v using (node))")
    out += [*cuts_sql(64, features, f"u{first}", "new_"), "p0m as materialized (select * from new_x)"]
    for k in range(more):
        out += _round_sql(f"p{k + 1}", f"p{k}m", "price", 3, 2, 0.3, 1.0, "l_n >= 1 and r_n >= 1 and l_h >= 1 and r_h >= 1")
    return ", ".join(out) + f" select flag, round(avg(m), 5) as prediction, count(*) as n from p{more}m group by flag"


@query(_updated_sql(2, 2))
def updated_boosting(spark, d):
    """A model of one half of the lines is written, read again and gets trees of the other half; predictions of the latter."""
    rows = lines(spark, d)
    model = Boosting.xgboost(["q", "d", "t"], label="price", n_estimators=2, max_depth=2, max_bins=64).fit(rows.where("id % 2 = 0"))
    folder = f"{shared_dir(spark)}/models/{uuid.uuid4().hex}"
    save(spark, model, folder)
    new = rows.where("id % 2 <> 0")
    return load(spark, folder).update(new, 2).predict(new).groupBy("flag").agg(F.round(F.avg("prediction"), 5).alias("prediction"), F.count("*").alias("n"))
