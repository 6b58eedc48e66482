"""SQL that grows trees level by level and adds them up, for whole fits of the tree ensembles."""

from __future__ import annotations

import math

from .lines import LINES

FEATURES = ("q", "d", "t")


def cuts_sql(bins: int, features: tuple[str, ...] = FEATURES, source: str = "l", p: str = "") -> list[str]:
    """CTEs, their names after p: k, the thresholds of each feature; x, the rows with the threshold that each value falls under
    (null: none)."""
    share = ", ".join(str(i / bins) for i in range(1, bins))
    values = " union all ".join(f"select {i} as f, {c} as v from {source}" for i, c in enumerate(features))
    return [
        f"{p}lv as materialized ({values})",
        f"{p}ls as (select f, max(v) as top, count(distinct v) as n from {p}lv group by f)",
        f"{p}k as materialized (select distinct f, v from (select f, unnest(quantile_cont(v, [{share}])) as v from {p}lv where f in (select f from {p}ls where n - 1 > {bins}) group by f union all select f, v from {p}lv where f in (select f from {p}ls where n - 1 <= {bins})) join {p}ls using (f) where v < top)",
        f"{p}kb as materialized (select f, v, (select min(k.v) from {p}k k where k.f = d.f and k.v >= d.v) as b from (select distinct f, v from {p}lv) d)",
        f"{p}x as materialized (select {source}.*, " + ", ".join(f"k{i}.b as b{i}" for i in range(len(features))) + f" from {source} " + " ".join(f"join {p}kb k{i} on k{i}.f = {i} and k{i}.v = {source}.{c}" for i, c in enumerate(features)) + ")",
    ]


def grow_sql(name: str, source: str, stats: list[str], gain: str, valid: str, depth: int, accept: str, open_: str = "true", width: int = len(FEATURES)) -> list[str]:
    """CTEs that end in {name}_{depth}: source (id, b0..., and the statistics) with the node of each row.

    gain, valid: over l_stat, r_stat, t_stat; open_: over t_stat, whether a node may be split.
    """
    out = [f"{name}_0 as materialized (select *, 0 as node from {source})"]
    for k in range(depth):
        p = f"{name}_{k}"
        each = " union all ".join(f"select node, {i} as f, b{i} as v, {', '.join(stats)} from {p} where node >= {2**k - 1}" for i in range(width))
        out += [
            f"{p}s as (select node, f, v, {', '.join(f'sum({s}) as {s}' for s in stats)} from ({each}) group by node, f, v)",
            f"{p}w as (select node, f, v, {', '.join(f'sum({s}) over a as l_{s}, sum({s}) over b as t_{s}' for s in stats)}, lead(f) over o as more from {p}s window o as (partition by node, f order by v nulls last), a as (partition by node, f order by v nulls last rows unbounded preceding), b as (partition by node, f))",
            f"{p}g as (select * from (select node, f, v, round({gain}, 12) as gain from (select *, {', '.join(f't_{s} - l_{s} as r_{s}' for s in stats)} from {p}w where more is not null and v is not null) where {valid} and {open_}) where gain > {accept})",
            f"{p}b as materialized (select node, f, v from {p}g qualify row_number() over (partition by node order by gain desc, f, v) = 1)",
            f"{name}_{k + 1} as materialized (select {p}.* exclude (node), case when c.node is null then {p}.node when case c.f " + " ".join(f"when {i} then b{i}" for i in range(width)) + f" end <= c.v then 2 * {p}.node + 1 else 2 * {p}.node + 2 end as node from {p} left join {p}b c on c.node = {p}.node)",
        ]
    return out


def boosted_sql(label: str, bins: int, rounds: int, depth: int, rate: float, base: str, g: str, h: str, gain: str, valid: str, leaf: str, link: str = "m") -> str:
    """Rounds of boosting; the mean prediction of each flag."""
    out = [f"with {LINES}", *cuts_sql(bins), f"base as (select avg({label}) as mean from l)", f"m0 as materialized (select x.*, {base} as m from x, base)"]
    for k in range(rounds):
        out.append(f"r{k} as materialized (select *, 1.0::double as n, {g} as g, {h} as h from m{k})")
        out += grow_sql(f"t{k}", f"r{k}", ["n", "g", "h"], gain, valid, depth, "1e-12", "t_n >= 2")
        out.append(f"v{k} as (select node, {leaf} as leaf from t{k}_{depth} group by node)")
        out.append(f"m{k + 1} as materialized (select t.* exclude (node, n, g, h, m, leaf), m + {rate} * leaf as m from (select * from t{k}_{depth} join v{k} using (node)) t)")
    return ", ".join(out) + f" select flag, round(avg({link}), 4) as prediction, count(*) as n from m{rounds} group by flag"


def oblivious_sql(label: str, bins: int, rounds: int, depth: int, rate: float, ridge: float) -> str:
    """Rounds of trees with one split a level for all leaves; squared loss."""
    out = [f"with {LINES}", *cuts_sql(bins), f"m0 as materialized (select x.*, (select avg({label}) from l) as m from x)"]
    score = lambda s: f"case when {s}n > 0 then {s}g * {s}g / ({s}n + {ridge}) else 0 end"
    for k in range(rounds):
        out.append(f"t{k}_0 as materialized (select *, m - {label} as g, 0 as node from m{k})")
        for j in range(depth):
            p = f"t{k}_{j}"
            each = " union all ".join(f"select node, {i} as f, b{i} as b, g from {p}" for i in range(len(FEATURES)))
            out += [
                f"{p}e as (select node, f, b, count(*) as n, sum(g) as g from ({each}) group by node, f, b)",
                f"{p}a as (select e.node, e.f, k.v, sum(case when b <= k.v then n else 0 end) as ln, sum(case when b <= k.v then g else 0 end) as lg, sum(n) as tn, sum(g) as tg from {p}e e join k using (f) group by e.node, e.f, k.v)",
                f"{p}b as materialized (select f, v from (select f, v, sum({score('l')} + {score('r')} - {score('t')}) as gain from (select *, tn - ln as rn, tg - lg as rg from {p}a) group by f, v) order by round(gain, 9) desc, f, v limit 1)",
                f"t{k}_{j + 1} as materialized (select {p}.* exclude (node), case when case c.f " + " ".join(f"when {i} then b{i}" for i in range(len(FEATURES))) + f" end <= c.v then 2 * {p}.node + 1 else 2 * {p}.node + 2 end as node from {p}, {p}b c)",
            ]
        out.append(f"m{k + 1} as materialized (select t.* exclude (node, g, m, leaf), m + {rate} * leaf as m from (select * from t{k}_{depth} join (select node, -sum(g) / (count(*) + {ridge}) as leaf from t{k}_{depth} group by node) using (node)) t)")
    return ", ".join(out) + f" select flag, round(avg(m), 4) as prediction, count(*) as n from m{rounds} group by flag"


def ordered_sql(label: str, bins: int, rounds: int, depth: int, rate: float, ridge: float, prior: float) -> str:
    """Rounds of ordered boosting with a category; of each block the mean margin of its own model, and of the model of all rows."""
    features = (*FEATURES, "s")
    score = lambda s: f"case when {s}n > 0 then {s}g * {s}g / ({s}n + {ridge}) else 0 end"
    out = [
        f"with {LINES}",
        f"p as (select *, row_number() over (order by {draw_sql('id', '0')}, id, {label}, q, d, t, status) - 1 as place from l)",
        f"o as materialized (select *, case when place = 0 then 0 else length(bin(place)) end as block, (coalesce(sum({label}) over w, 0) + {prior}::double) / (count(*) over w + 1) as s from p window w as (partition by status order by place rows between unbounded preceding and 1 preceding))",
        *cuts_sql(bins, features, "o"),
        "top as (select max(block) + 1 as k from o)",
        f"n as (select r.k, (select coalesce(sum({label}), 0) from o where block < r.k) as t, (select count(*) from o where block < r.k) as n from (select unnest(range(0, (select k + 1 from top))) as k) r)",
        "e0 as materialized (select place, block, n.k, case when n.n = 0 then 0 else ln((n.t + 0.5) / (n.n + 1) / (1 - (n.t + 0.5) / (n.n + 1))) end as m from o join n on n.k >= block)",
    ]
    for r in range(rounds):
        out.append(f"t{r}_0 as materialized (select x.place, x.block, {', '.join(f'b{i}' for i in range(len(features)))}, {label} as y, 1 / (1 + exp(-m)) - {label} as g, 0 as node from x join e{r} e on e.place = x.place and e.k = x.block)")
        for j in range(depth):
            p = f"t{r}_{j}"
            each = " union all ".join(f"select node, {i} as f, b{i} as b, g from {p}" for i in range(len(features)))
            out += [
                f"{p}e as (select node, f, b, count(*) as n, sum(g) as g from ({each}) group by node, f, b)",
                f"{p}a as (select e.node, e.f, k.v, sum(case when b <= k.v then n else 0 end) as ln, sum(case when b <= k.v then g else 0 end) as lg, sum(n) as tn, sum(g) as tg from {p}e e join k using (f) group by e.node, e.f, k.v)",
                f"{p}b as materialized (select f, v from (select f, v, sum({score('l')} + {score('r')} - {score('t')}) as gain from (select *, tn - ln as rn, tg - lg as rg from {p}a) group by f, v) order by round(gain, 9) desc, f, v limit 1)",
                f"t{r}_{j + 1} as materialized (select {p}.* exclude (node), case when case c.f " + " ".join(f"when {i} then b{i}" for i in range(len(features))) + f" end <= c.v then 2 * {p}.node + 1 else 2 * {p}.node + 2 end as node from {p}, {p}b c)",
            ]
        out += [
            f"v{r} as (select node, k, -{rate} * sum(1 / (1 + exp(-m)) - y) / (count(*) + {ridge}) as v from t{r}_{depth} t join e{r} e using (place) where e.k > e.block group by node, k)",
            f"e{r + 1} as materialized (select e.place, e.block, e.k, e.m + coalesce(v.v, 0) as m from e{r} e join t{r}_{depth} t using (place) left join v{r} v on v.node = t.node and v.k = e.k)",
        ]
    return ", ".join(out) + f" select block, count(*) as n, round(avg(m) filter (where e.k = block), 5) as margin, round(avg(m) filter (where e.k = top.k), 5) as last_margin from (select * from e{rounds} e where e.k = block or e.k = (select k from top)) e, top group by block".replace("count(*)", "count(*) filter (where e.k = block)")


def draw_sql(key: str, seed: str) -> str:
    return f"(cast('0x' || substr(md5('{seed}:' || {key}), 1, 8) as bigint) / 4294967296.0)"


def forest_sql(trees: int, depth: int, bins: int) -> str:
    """Gini trees of flag on Poisson weights, their majority, and its confusion with flag."""
    steps, total, out = [], 0.0, [f"with {LINES}", *cuts_sql(bins)]
    for j in range(6):
        total += math.exp(-1) / math.factorial(j)
        steps.append(total)
    share = lambda s: f"(1 - ({' + '.join(f'({s}_c{i} / {s}_n) * ({s}_c{i} / {s}_n)' for i in range(3))}))"
    for k in range(trees):
        u = draw_sql("id", f"0:{k}")
        out.append(f"u{k} as (select *, {u} as u from {f'y{k - 1}' if k else 'x'})")
        out.append(f"r{k} as materialized (select *, " + ", ".join(f"case when flag = '{c}' then n else 0 end as c{i}" for i, c in enumerate("ANR")) + f" from (select *, case {' '.join(f'when u < {s!r} then {j}.0' for j, s in enumerate(steps))} else 6.0 end as n from u{k}))")
        # Rows of weight 0 go along to be voted on; they add nothing to any sum.
        out += grow_sql(f"t{k}", f"r{k}", ["n", "c0", "c1", "c2"], f"{share('t')} - l_n / t_n * {share('l')} - r_n / t_n * {share('r')}", "l_n >= 1 and r_n >= 1", depth, "-1", "t_n >= 2 and (t_c0 > 0)::int + (t_c1 > 0)::int + (t_c2 > 0)::int > 1")
        out.append(f"v{k} as (select node, case when sum(c0) >= sum(c1) and sum(c0) >= sum(c2) then 0 when sum(c1) >= sum(c2) then 1 else 2 end as vote from t{k}_{depth} group by node)")
        out.append(f"y{k} as materialized (select t.* exclude (node, u, n, c0, c1, c2, vote), vote as vote{k} from (select * from t{k}_{depth} join v{k} using (node)) t)")
    count = lambda c: " + ".join(f"(vote{k} = {c})::int" for k in range(trees))
    return ", ".join(out) + f", n as (select flag, {count(0)} as a, {count(1)} as b, {count(2)} as c from y{trees - 1}) select flag as actual, case when a >= b and a >= c then 'A' when b >= c then 'N' else 'R' end as predicted, count(*) as n from n group by 1, 2"


def adaboost_sql(rounds: int, bins: int) -> str:
    """Rounds of stumps on thresholds of each feature."""
    out = [f"with {LINES}", *cuts_sql(bins), "w0 as materialized (select id, b0, b1, b2, case when label = 1 then 1 else -1 end as y, 1.0::double / count(*) over () as w from x)"]
    for k in range(rounds):
        each = " union all ".join(f"select {i} as f, b{i} as v, y, w from w{k}" for i in range(3))
        out += [
            f"g{k} as (select f, v, sum(case when y > 0 then w else 0 end) as p, sum(case when y < 0 then w else 0 end) as m, count(*) as n from ({each}) group by f, v)",
            f"c{k} as (select f, v, sum(p) over a as lp, sum(m) over a as lm, sum(n) over a as ln, sum(p) over b as tp, sum(m) over b as tm, sum(n) over b as tn from g{k} window a as (partition by f order by v nulls last rows unbounded preceding), b as (partition by f))",
            f"s{k} as materialized (select f, v, case when miss <= other then 1 else -1 end as pol, 0.5 * ln((1 - least(miss, other)) / least(miss, other)) as alpha from (select f, v, lp + tm - lm as miss, lm + tp - lp as other from c{k} where ln < tn and v is not null) order by round(greatest(1 - miss, 1 - other), 12) desc, f, v limit 1)",
            f"u{k} as (select w{k}.*, w * case when (case when case f when 0 then b0 when 1 then b1 else b2 end <= v then -pol else pol end) <> y then exp(alpha) else 1 end as nw from w{k}, s{k})",
            f"w{k + 1} as materialized (select id, b0, b1, b2, y, nw / sum(nw) over () as w from u{k})",
        ]
    return ", ".join(out) + " " + " union all ".join(f"select {k} as learner, case f when 0 then 'q' when 1 then 'd' else 't' end as feature, round(v, 6) as threshold, pol as polarity, round(alpha, 6) as alpha from s{k}" for k in range(rounds))


_RATED = "r as materialized (select o_custkey as u, l_suppkey as i, least(5.0, greatest(1.0, avg(l_quantity) / 10))::double as r from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"


def factorization_sql(epochs: int, factors: int = 2, rate: float = 0.05, decay: float = 0.5, reg: float = 0.02, top: int | None = None) -> str:
    """The loss of each epoch, or the first items of each user that it has not rated."""
    normal = lambda c, side, j: f"sqrt(-2 * ln(1 - {draw_sql(c, f'0:{j}:{side}')})) * cos(2 * pi() * {draw_sql(c, f'0:{j}:{side}2')}) * 0.1"
    out = [f"with {_RATED}", "mu as (select avg(r) as mu from r)"]
    for side, c in (("user", "u"), ("item", "i")):
        out.append(f"{c}0 as materialized (select {c}, 0.0::double as b, {', '.join(f'{normal(c, side, j)} as f{j}' for j in range(factors))} from (select distinct {c} from r))")
    for k in range(epochs):
        out.append(f"e{k} as materialized (select u, i, r - least(5, greatest(1, mu + x.b + y.b + {' + '.join(f'x.f{j} * y.f{j}' for j in range(factors))})) as e, x.b as bu, y.b as bi, {', '.join(f'x.f{j} as u{j}, y.f{j} as v{j}' for j in range(factors))} from r join u{k} x using (u) join i{k} y using (i), mu)")
        step = rate * decay**k
        for c, b, f, g in (("u", "bu", "u", "v"), ("i", "bi", "v", "u")):
            out.append(f"{c}{k + 1} as materialized (select {c}, any_value({b}) + {step} * (sum(e) - {reg} * count(*) * any_value({b})) as b, {', '.join(f'any_value({f}{j}) + {step} * (sum(e * {g}{j}) - {reg} * count(*) * any_value({f}{j})) as f{j}' for j in range(factors))} from e{k} group by {c})")
    if top:
        score = f"least(5, greatest(1, mu + x.b + y.b + {' + '.join(f'x.f{j} * y.f{j}' for j in range(factors))}))"
        return ", ".join(out) + f', p as (select u, i, {score} as p from u{epochs} x, i{epochs} y, mu where not exists (select 1 from r where r.u = x.u and r.i = y.i)) select u as "user", i as item, cast(row_number() over (partition by u order by p desc, i) as int) as rank from p qualify rank <= {top}'
    return ", ".join(out) + " " + " union all ".join(f"select {k} as epoch, round(avg(e * e), 6) as loss from e{k}" for k in range(epochs))
