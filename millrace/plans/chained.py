"""Hidden Markov models of events as rows; the SQL goes forward and back through each sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chains import LongChains
from ..operators.sequences import HiddenMarkov
from ..sources.tables import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def chains(spark, d) -> tuple:
    events = read(spark, d, "events")
    symbols = sorted(r[0] for r in events.select("event_type").distinct().collect())
    k = len(symbols)
    rise = [2 * (i + 1) / (k * (k + 1)) for i in range(k)]
    model = HiddenMarkov(["a", "b"], symbols, [0.6, 0.4], [[0.7, 0.3], [0.4, 0.6]], [rise, rise[::-1]])
    return LongChains(model, ["ts", "event_id"], "user_id", "event_type", chunk=16, fan=4), events


def _welch_sql(rounds: int, last: str) -> str:
    out = [
        "with recursive o as materialized (select user_id as u, event_type as x, row_number() over (partition by user_id order by ts, event_id) as t, count(*) over (partition by user_id) as n from events)",
        "s as (select event_type as x, row_number() over (order by event_type) as i, count(*) over () as k from (select distinct event_type from events))",
        "m0 as materialized (select x, 2.0::double * i / (k * (k + 1)) as ea, 2.0::double * (k + 1 - i) / (k * (k + 1)) as eb from s)",
        "p0 as materialized (select 0.6::double as pa, 0.4::double as pb, 0.7::double as aa, 0.3::double as ab, 0.4::double as ba, 0.6::double as bb)",
    ]
    for r in range(rounds + 1):
        out += [
            f"e{r} as materialized (select o.*, ea, eb from o join m{r} using (x))",
            f"f{r} as (select u, t, pa * ea as a, pb * eb as b from e{r}, p{r} where t = 1 union all select e.u, e.t, (f.a * aa + f.b * ba) * ea, (f.a * ab + f.b * bb) * eb from f{r} f join e{r} e on e.u = f.u and e.t = f.t + 1, p{r})",
        ]
        if r == rounds:
            break
        out += [
            f"g{r} as (select u, t, 1.0::double as a, 1.0::double as b, ea, eb from e{r} where t = n union all select e.u, e.t, aa * g.ea * g.a + ab * g.eb * g.b, ba * g.ea * g.a + bb * g.eb * g.b, e.ea, e.eb from g{r} g join e{r} e on e.u = g.u and e.t = g.t - 1, p{r})",
            f"h{r} as materialized (select e.u, e.t, e.x, f.a * g.a / (f.a * g.a + f.b * g.b) as ga, f.b * g.b / (f.a * g.a + f.b * g.b) as gb from e{r} e join f{r} f on f.u = e.u and f.t = e.t join g{r} g on g.u = e.u and g.t = e.t)",
            f"x{r} as (select sum(f.a * aa * g.ea * g.a / l) as aa, sum(f.a * ab * g.eb * g.b / l) as ab, sum(f.b * ba * g.ea * g.a / l) as ba, sum(f.b * bb * g.eb * g.b / l) as bb from (select f.*, f.a * k.a + f.b * k.b as l from f{r} f join g{r} k on k.u = f.u and k.t = f.t) f join g{r} g on g.u = f.u and g.t = f.t + 1, p{r})",
            f"p{r + 1} as materialized (select i.a / (i.a + i.b) as pa, i.b / (i.a + i.b) as pb, x.aa / (x.aa + x.ab) as aa, x.ab / (x.aa + x.ab) as ab, x.ba / (x.ba + x.bb) as ba, x.bb / (x.ba + x.bb) as bb from (select sum(ga) as a, sum(gb) as b from h{r} where t = 1) i, (select aa + 1e-12 as aa, ab + 1e-12 as ab, ba + 1e-12 as ba, bb + 1e-12 as bb from x{r}) x)",
            f"m{r + 1} as materialized (select x, a / sum(a) over () as ea, b / sum(b) over () as eb from (select x, sum(ga) as a, sum(gb) as b from h{r} group by x))",
        ]
    return ", ".join(out) + last.format(n=rounds)


@query(_welch_sql(2, " select x as symbol, round(ea, 6) as a, round(eb, 6) as b from m{n} union all select 'to a', round(aa, 6), round(ba, 6) from p{n} union all select 'to b', round(ab, 6), round(bb, 6) from p{n} union all select 'start', round(pa, 6), round(pb, 6) from p{n}"))
def baum_welch(spark, d):
    """The parameters of both states after two rounds."""
    c, events = chains(spark, d)
    m = c.fit(events, 2).model
    rows = [(s, m.emission[0, i], m.emission[1, i]) for i, s in enumerate(m.symbols)] + [("to a", *m.transition[:, 0]), ("to b", *m.transition[:, 1]), ("start", *m.initial)]
    return spark.createDataFrame([(s, round(float(a), 6), round(float(b), 6)) for s, a, b in rows], "symbol string, a double, b double")


@query(_welch_sql(0, " select u as user_id, round(ln(a + b), 5) as log_likelihood, round(exp(-ln(a + b) / t), 5) as perplexity from f{n} qualify row_number() over (partition by u order by t desc) = 1"))
def chain_likelihoods(spark, d):
    """Log likelihood and perplexity of each user's events."""
    c, events = chains(spark, d)
    return c.score(events).select("user_id", F.round("log_likelihood", 5).alias("log_likelihood"), F.round("perplexity", 5).alias("perplexity"))
