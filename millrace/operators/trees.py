"""One level-wise split kernel, and the trees, forests and boosted ensembles that differ in statistics and gain."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.expr import num, sigmoid
from ..functions.prepare import draw
from .linear import complete
from .loop import dealt, removed, written

Tree = dict[int, dict]  # node -> {feature, threshold, gain, stats} or {value, stats}; children 2i + 1 and 2i + 2


def compile_tree(tree: Tree, features: list[str], leaf=None, node: int = 0) -> str:
    """The tree as nested CASE text; leaf(node) is what a leaf gives, its value by default."""
    n = tree[node]
    if "feature" not in n:
        return leaf(node) if leaf else num(n["value"])
    return f"case when {features[n['feature']]} <= {num(n['threshold'])} then {compile_tree(tree, features, leaf, 2 * node + 1)} else {compile_tree(tree, features, leaf, 2 * node + 2)} end"


#: Distinct values of a feature up to which its percentiles are exact; beyond, they are those of a mergeable summary, off
#: by one part in PERCENTILE_ACCURACY of the rows at most.
EXACT_VALUES, PERCENTILE_ACCURACY = 100_000, 10_000


class Values(list):
    """Thresholds that are all values of a feature but the greatest: a value is its own bin."""


def cut_points(df: DataFrame, features: list[str], bins: int, exact_values: int = EXACT_VALUES, also: dict[str, Column] | None = None) -> list[list[float]]:
    """At most bins thresholds of each feature, without its greatest value: all values where they are so few, else percentiles.

    One scan keeps the values of features that have few (in a sketch of bounded size that is exact for so few) and counts
    those of the others; a second one takes the percentiles of the others.  also: aggregates that go along; their values
    replace them.
    """
    also = also if also is not None else {}
    if not features and not also:
        return []
    counts = [F.approx_count_distinct(f) for f in features] + [F.max(f) for f in features] + [F.expr(f"approx_top_k(cast({f} as double), {bins + 2}, {2 * bins + 8})") for f in features] + [F.count(f) for f in features]
    r = df.agg(*counts, *also.values()).first()
    also.update(zip(also, r[4 * len(features) :]))
    share = ", ".join(f"{i / bins}D" for i in range(1, bins)) or "0.5D"
    found: list[list[float]] = []
    for distinct, top, held, n in zip(*(r[k * len(features) : (k + 1) * len(features)] for k in range(4))):
        values = sorted({float(x[0]) for x in held or [] if x[0] is not None})
        # The sketch has all values if their counts add up; beyond its size it drops some.
        whole = distinct <= 2 * bins + 8 and len(values) <= bins + 1 and sum(x[1] for x in held or []) == n
        found.append(Values(v for v in values if v < top) if whole else [])
    more = [i for i in range(len(features)) if not isinstance(found[i], Values)]
    if more:
        kind = lambda i: f"percentile({features[i]}, array({share}))" if r[i] <= exact_values else f"percentile_approx({features[i]}, array({share}), {PERCENTILE_ACCURACY})"
        for i, x in zip(more, df.agg(*[F.expr(kind(i)) for i in more]).first()):
            found[i] = sorted({float(v) for v in x if v < r[len(features) + i]})
    return found


#: Thresholds that one CASE text searches; with more, it finds the run of thresholds, and an array function the place in it.
CASE_CUTS = 32


def _search(value: str, cuts: list[float], at: int = 0) -> str:
    """How many of the sorted cuts are below value, as SQL text: a binary search by nested CASE."""
    if not cuts:
        return str(at)
    mid = len(cuts) // 2
    return f"case when {value} <= {num(cuts[mid])} then {_search(value, cuts[:mid], at)} else {_search(value, cuts[mid + 1 :], at + mid + 1)} end"


def _bin(value: str, cuts: list[float]) -> str:
    if len(cuts) <= CASE_CUTS:
        return _search(value, cuts)
    step = -(-len(cuts) // CASE_CUTS)
    runs = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    run = _search(value, [r[-1] for r in runs[:-1]])
    lists = ", ".join(f"array({', '.join(map(num, r))})" for r in runs)
    return f"{step} * ({run}) + size(filter(element_at(array({lists}), 1 + ({run})), c -> c < {value}))"


def binned(df: DataFrame, features: list[str], cuts: list[list[float]] | None) -> DataFrame:
    """df with the bin of each feature whose thresholds are not all its values, b_0, b_1, ...: how many of them are below the
    value; callers keep the result for the whole fit."""
    own = {f"b_{i}": F.expr(f"cast({_bin(f, sorted(c))} as int)") for i, (f, c) in enumerate(zip(features, cuts or [])) if not isinstance(c, Values)}
    return df.withColumns(own) if own else df


def prepared(rows: DataFrame, features: list[str], bins: int | None, exact_values: int = EXACT_VALUES, also: dict[str, Column] | None = None, checked: list[str] | None = None) -> tuple[DataFrame, list[list[float]] | None, list[DataFrame]]:
    """(rows with bins, thresholds, what is kept in memory until the fit ends): rows are read once and dealt over the cores.
    Nulls and NaN in checked, by default the features, are an error."""
    kept = [dealt(rows).persist()]
    try:
        complete(kept[0], features if checked is None else checked)
    except ValueError:
        kept[0].unpersist()
        raise
    if not bins:
        if also:
            also.update(zip(also, kept[0].agg(*also.values()).first()))
        return kept[0], None, kept
    cuts = cut_points(kept[0], features, bins, exact_values, also)
    out = binned(kept[0], features, cuts)
    if out is not kept[0]:
        kept.append(out.persist())
    return out, cuts, kept


#: Nodes up to which the way through trees is one CASE text; with more, it is lookups by number, a step a level.
CASE_NODES = 256


class Places:
    """The nodes of one or more trees, numbered on from their roots: the way of a row from a root to its leaf."""

    def __init__(self, trees: int = 1) -> None:
        self.trees, self.node = trees, [(t, 0) for t in range(trees)]
        self.feature, self.threshold, self.left = [-1] * trees, [0.0] * trees, list(range(trees))
        self.depth = 0

    def split(self, place: int, feature: int, threshold: float) -> tuple[int, int]:
        tree, node = self.node[place]
        self.feature[place], self.threshold[place], self.left[place] = feature, threshold, len(self.node)
        for child in (2 * node + 1, 2 * node + 2):
            self.node.append((tree, child))
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(len(self.node) - 1)
        self.depth = max(self.depth, (2 * node + 2).bit_length() - 1)
        return len(self.node) - 2, len(self.node) - 1

    def _case(self, features: list[str], place: int) -> str:
        f, left = self.feature[place], self.left[place]
        return str(place) if f < 0 else f"case when {features[f]} <= {num(self.threshold[place])} then {self._case(features, left)} else {self._case(features, left + 1)} end"

    def found(self, rows: DataFrame, features: list[str], root: str | None = None, name: str = "node_") -> DataFrame:
        """rows with the number of the leaf that they come to, from the root of the tree (SQL of its number, the first by default)."""
        if len(self.node) <= CASE_NODES:
            each = [self._case(features, t) for t in range(self.trees)]
            return rows.withColumn(name, F.expr(each[0] if root is None else f"case {root} " + " ".join(f"when {t} then {x}" for t, x in enumerate(each)) + " end"))
        out = rows.withColumn(name, F.lit(0) if root is None else F.expr(root))
        feature, threshold, left = F.lit(np.array(self.feature, np.int32)), F.lit(np.array(self.threshold)), F.lit(np.array(self.left, np.int32))
        value = "case feature_ " + " ".join(f"when {i} then cast({features[i]} as double)" for i in sorted({f for f in self.feature if f >= 0})) + " end"
        for _ in range(self.depth):
            out = out.withColumn("feature_", feature[F.col(name)])
            out = out.withColumn(name, F.when(F.col("feature_") < 0, F.col(name)).otherwise(left[F.col(name)] + F.when(F.expr(value) <= threshold[F.col(name)], 0).otherwise(1)))
        return out.drop("feature_")


def placed(tree: Tree, root: int = 0) -> Places:
    out, todo = Places(), [(0, root)]
    while todo:
        place, node = todo.pop()
        if "feature" in tree[node]:
            todo += zip(out.split(place, tree[node]["feature"], tree[node]["threshold"]), (2 * node + 1, 2 * node + 2))
    return out


def stepped(rows: DataFrame, tree: Tree, features: list[str], margin: str, rate: float) -> DataFrame:
    """rows with the margin moved by rate times the value of the tree."""
    if len(tree) <= CASE_NODES:
        return rows.withColumn(margin, F.expr(f"{margin} + {num(rate)} * ({compile_tree(tree, features)})"))
    places = placed(tree)
    values = F.lit(np.array([float(tree[n].get("value", 0.0)) for _, n in places.node]))
    return places.found(rows, features).withColumn(margin, F.col(margin) + F.lit(float(rate)) * values[F.col("node_")]).drop("node_")


def grow(df: DataFrame, features: list[str], stats: dict[str, str], gain: str, valid: str, value, max_depth: int | None, accept: float, splittable=lambda s: True, cuts: list[list[float]] | None = None, columns: list[int] | None = None, max_leaves: int | None = None, bundles: list[list[int]] | None = None) -> Tree:
    """The tree of rows that the caller keeps in memory: see grow_all()."""
    return grow_all(df, features, stats, gain, valid, value, max_depth, accept, splittable, cuts, columns, max_leaves, bundles=bundles)[0]


def _code(features: list[str], cuts: list[list[float]] | None, f: int) -> tuple[str, float]:
    """SQL of a feature's bin (the value itself where all are thresholds), and the bin of 0."""
    if cuts is None or isinstance(cuts[f], Values):
        return f"cast({features[f]} as double)", 0.0
    return f"cast(b_{f} as double)", float(sum(c < 0 for c in cuts[f]))


def entries(features: list[str], columns: list[int], cuts: list[list[float]] | None, bundles: list[list[int]] | None) -> str:
    """SQL array of the (f, v) that a row adds to the histograms: one a feature; of a bundle, that of the feature which is
    not at the bin of 0, if any, and then (-1, 0) for the totals that the bins of 0 are worked out from."""
    own = [[f for f in b if f in columns] for b in bundles or []]
    held = {f for b in own for f in b}
    out = [f"struct({f} as f, {_code(features, cuts, f)[0]} as v)" for f in columns if f not in held]
    for b in own:
        if b:
            out.append("case " + " ".join("when {0} <> {1}D then struct({2} as f, {0} as v)".format(*_code(features, cuts, f), f) for f in b) + " end")
    return "array(" + ", ".join(out + ["struct(-1 as f, 0D as v)"] * bool(held)) + ")"


def exclusive_bundles(rows: DataFrame, features: list[str], cuts: list[list[float]] | None, max_share: float = 0.5, max_conflicts: float = 0.0) -> list[list[int]]:
    """Features that are rarely away from the bin of 0 (on max_share of the rows at most), in bundles in which no more than
    max_conflicts of the rows have two of them away from it: with 0, trees are as without bundles.

    Pairs are counted map-side within rows, so features squared numbers leave a task; the bundles are then filled first
    fit, the features with the most conflicts first.
    """
    away = "filter(array(" + ", ".join("case when {0} <> {1}D then {2} end".format(*_code(features, cuts, f), f) for f in range(len(features))) + "), x -> x is not null)"
    own = rows.select(F.expr(away).alias("a"))
    found = own.select(F.explode("a").alias("f"), "a").select("f", F.explode("a").alias("g")).where("f <= g").groupBy("f", "g").agg(F.count("*").alias("n")).collect()
    n = rows.count()
    both = {(r["f"], r["g"]): r["n"] for r in found}
    both |= {(g, f): c for (f, g), c in both.items()}
    sparse = [f for f in range(len(features)) if both.get((f, f), 0) <= max_share * n]
    clashes = lambda f, others: sum(both.get((f, g), 0) for g in others if g != f)
    out: list[list] = []  # [features, conflicts so far]
    for f in sorted(sparse, key=lambda f: (-clashes(f, sparse), -both.get((f, f), 0), f)):
        for b in out:
            if b[1] + clashes(f, b[0]) <= max_conflicts * n:
                b[1] += clashes(f, b[0])
                b[0].append(f)
                break
        else:
            out.append([[f], 0])
    return [sorted(b[0]) for b in out if len(b[0]) > 1]


def _with_zeros(sums: DataFrame, names: list[str], zeros: dict[int, float]) -> DataFrame:
    """Sums (node, f, v, ...) with those of the bins of 0 of the features in zeros: the totals of the node (f = -1) less all
    other bins of the feature."""
    at, own = Window.partitionBy("node"), Window.partitionBy("node", "f")
    total = sums.select("*", *[F.sum(F.when(F.col("f") == -1, F.col(n)).otherwise(0.0)).over(at).alias(f"t_{n}") for n in names]).where("f >= 0")
    total = total.select("*", *[F.sum(n).over(own).alias(f"o_{n}") for n in names], F.row_number().over(own.orderBy("v")).alias("k"))
    zero = "case f " + " ".join(f"when {f} then {z}D" for f, z in zeros.items()) + " end"
    row = "struct(v as v, " + ", ".join(f"{n} as {n}" for n in names) + ")"
    more = f"struct({zero} as v, " + ", ".join(f"t_{n} - o_{n} as {n}" for n in names) + ")"
    out = total.select("node", "f", F.explode(F.expr(f"if(k = 1 and f in ({', '.join(map(str, zeros))}), array({row}, {more}), array({row}))")).alias("c"))
    return out.select("node", "f", "c.v", *[F.col(f"c.{n}").alias(n) for n in names]).where(F.col(names[0]) > 1e-9)


def grow_all(df: DataFrame, features: list[str], stats: dict[str, str], gain: str, valid: str, value, max_depth: int | None, accept: float, splittable=lambda s: True, cuts: list[list[float]] | None = None, columns: list[int] | None = None, max_leaves: int | None = None, weights: str | None = None, trees: int = 1, bundles: list[list[int]] | None = None) -> list[Tree]:
    """Trees on the same rows, one job a level for all nodes of all of them; with max_leaves (one tree) the leaf of the
    greatest gain is split next, one job a split.

    stats: name -> SQL of what is summed, with weights of w_, the row's weight in the tree: weights is SQL of an array
    of them; rows of weight 0 are not in a tree.  gain and valid: SQL over l_name, r_name, t_name (left, right,
    both); value: statistics -> leaf value; a split needs gain > accept.  Of equal gains (to 12 digits)
    the first feature and the least threshold win.  Candidates are the cuts of a feature, of which df has the bins
    (binned()), so at most as many rows a node and feature reach a window; without cuts they are all values.
    bundles: features of which a row adds one at most to the histograms (exclusive_bundles()).
    """
    names, d = list(stats), columns if columns is not None else list(range(len(features)))
    coded = [f for f in d if cuts is not None and not isinstance(cuts[f], Values)]
    held = [f for b in bundles or [] for f in b if f in d]
    base, root = df, None
    if weights is not None:
        base, root = df.select("*", F.posexplode(F.expr(weights)).alias("tree_", "w_")).where("w_ > 0"), "tree_"
    out: list[Tree] = [{0: {}} for _ in range(trees)]
    places = Places(trees)
    w = Window.partitionBy("node", "f")

    def best(open_: list[int]) -> list:
        of = np.zeros(len(places.node), bool)
        of[open_] = True
        each = F.explode(F.expr(entries(features, d, cuts, bundles))).alias("c")
        rows = places.found(base, features, root).where(F.lit(of)[F.col("node_")] if not of.all() else F.lit(True))
        sums = rows.select(F.col("node_").alias("node"), *[F.expr(e).alias(n) for n, e in stats.items()], each)
        sums = (sums.where("c is not null") if held else sums).groupBy("node", "c.f", "c.v").agg(*[F.sum(n).alias(n) for n in names])
        sums = _with_zeros(sums, names, {f: _code(features, cuts, f)[1] for f in held}) if held else sums
        if coded:
            sums = sums.withColumn("v", F.expr("case f " + " ".join(f"when {f} then try_element_at(array({', '.join(map(num, cuts[f])) or 'double(null)'}), cast(v as int) + 1)" for f in coded) + " else v end"))
        order = w.orderBy(F.col("v").asc_nulls_last())
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        both = sums.select("node", "f", "v", *[F.sum(n).over(upto).alias(f"l_{n}") for n in names], *[F.sum(n).over(w).alias(f"t_{n}") for n in names], F.lead("f").over(order).alias("more"))
        both = both.where("more is not null and v is not null").select("*", *[F.expr(f"t_{n} - l_{n}").alias(f"r_{n}") for n in names]).where(valid).withColumn("gain", F.expr(f"round({gain}, 12)")).where(F.col("gain") > accept)
        first = F.min(F.struct((-F.col("gain")).alias("loss"), "f", "v", "gain", *[f"{k}_{n}" for k in "lrt" for n in names])).alias("s")
        return sorted((r["s"].asDict() | {"node": r["node"]} for r in both.groupBy("node").agg(first).collect()), key=lambda r: r["node"])

    def divide(r) -> list[int]:
        tree, node = places.node[r["node"]]
        out[tree][node].update(feature=r["f"], threshold=r["v"], gain=r["gain"])
        more = []
        for place, child, side in zip(places.split(r["node"], r["f"], r["v"]), (2 * node + 1, 2 * node + 2), "lr"):
            s = {k: float(r[f"{side}_{k}"]) for k in names}
            out[tree][child] = {"stats": s, "value": value(s)}
            if splittable(s) and (max_depth is None or (child + 1).bit_length() - 1 < max_depth):
                more.append(place)
        return more

    # The roots' sums come with their splits, and by a job of their own only where one has none.
    found = best(list(range(trees))) if max_depth != 0 else []
    totals = {r["node"]: [r[f"t_{n}"] for n in names] for r in found}
    if len(totals) < trees:
        rows = base.select((F.lit(0) if root is None else F.expr(root)).alias("node"), *[F.expr(e).alias(n) for n, e in stats.items()])
        totals |= {r[0]: r[1:] for r in rows.groupBy("node").agg(*[F.sum(n).alias(n) for n in names]).collect()}
    for t in range(trees):
        s = dict(zip(names, (float(x or 0) for x in totals.get(t, [0.0] * len(names)))))
        out[t][0] = {"stats": s, "value": value(s) if any(s.values()) else 0.0}
    found = [r for r in found if splittable(out[r["node"]][0]["stats"])]
    offers, leaves = [], 1
    while found:
        open_: list[int] = []
        if max_leaves is None:
            for r in found:
                open_ += divide(r)
        else:
            offers = sorted([*offers, *found], key=lambda r: (-r["gain"], places.node[r["node"]][1]))
            while offers and leaves < max_leaves and not open_:
                open_, leaves = divide(offers.pop(0)), leaves + 1
            if leaves >= max_leaves:
                break
        found = best(open_) if open_ else []
    return out


def depth_of(tree: Tree, node: int = 0) -> int:
    return 1 if "feature" not in tree[node] else 1 + max(depth_of(tree, 2 * node + 1), depth_of(tree, 2 * node + 2))


def splits(tree: Tree) -> list[dict]:
    return [n for n in tree.values() if "feature" in n]


def _impurity(criterion: str, side: str, classes: int) -> str:
    if criterion == "mse":
        return f"({side}_s2 / {side}_n - pow({side}_s / {side}_n, 2))"
    share = [f"({side}_c{i} / {side}_n)" for i in range(classes)]
    return f"(1 - ({' + '.join(f'{p} * {p}' for p in share)}))" if criterion == "gini" else f"(-({' + '.join(f'{p} * log2({p} + 1e-10D)' for p in share)}))"


@dataclass
class DecisionTree:
    features: list[str]
    label: str = "label"
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    criterion: str = "gini"
    task: str = "classification"
    max_bins: int | None = 256  # None: all values are candidates, and those of a feature and node meet in one task
    exact_values: int = EXACT_VALUES
    classes: list | None = None
    tree: Tree | None = None

    def fit(self, df: DataFrame) -> DecisionTree:
        rows, cuts, kept = prepared(df.select(*self.features, self.label), self.features, self.max_bins, self.exact_values)
        self.tree = self._all(rows, cuts)[0]
        for x in kept:
            x.unpersist()
        return self

    def _all(self, rows: DataFrame, cuts: list[list[float]] | None, weights: str | None = None, trees: int = 1) -> list[Tree]:
        """Trees of rows that the caller keeps, with the weights of each row."""
        if self.task not in ("classification", "regression") or self.criterion not in ("gini", "entropy", "mse"):
            raise ValueError("unknown task or criterion")
        weight = "1D" if weights is None else "w_"
        stats = {"n": weight}
        if self.task == "classification":
            self.classes = self.classes or [r[0] for r in rows.select(self.label).distinct().orderBy(self.label).collect()]
            stats |= {f"c{i}": f"case when {self.label} = {c!r} then {weight} else 0D end" for i, c in enumerate(self.classes)}
            kind, value = self.criterion, lambda s: int(np.argmax([s[f"c{i}"] for i in range(len(self.classes))]))
            mixed = lambda s: sum(s[f"c{i}"] > 0 for i in range(len(self.classes))) > 1
        else:
            stats |= {"s": f"{weight} * {self.label}", "s2": f"{weight} * {self.label} * {self.label}"}
            kind, value = "mse", lambda s: s["s"] / s["n"] if s["n"] else 0.0
            mixed = lambda s: s["s2"] / s["n"] - (s["s"] / s["n"]) ** 2 > 1e-12
        i = {k: _impurity(kind, k, len(self.classes or [])) for k in "tlr"}
        gain = f"{i['t']} - l_n / t_n * {i['l']} - r_n / t_n * {i['r']}"
        return grow_all(rows, self.features, stats, gain, f"l_n >= {self.min_samples_leaf} and r_n >= {self.min_samples_leaf}", value, self.max_depth, -1, lambda s: s["n"] >= self.min_samples_split and mixed(s), cuts, weights=weights, trees=trees)

    def leaf_expr(self) -> str:
        return compile_tree(self.tree, self.features, (lambda n: repr(self.classes[self.tree[n]["value"]])) if self.classes else None)

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.expr(self.leaf_expr()))

    def score(self, df: DataFrame) -> float | None:
        return (metrics.accuracy if self.task == "classification" else metrics.r2)(self.predict(df), self.label)

    def get_depth(self) -> int:
        return depth_of(self.tree)

    def get_n_leaves(self) -> int:
        return sum("feature" not in n for n in self.tree.values())


@dataclass
class RandomForest:
    """Bagged trees.  A row's weight in a tree is a Poisson(1) draw from a hash of (seed, tree, key)."""

    features: list[str]
    label: str = "label"
    key: str = "id"
    n_estimators: int = 10
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    bootstrap: bool = True
    criterion: str = "gini"
    task: str = "classification"
    seed: int = 0
    max_bins: int | None = 32
    trees: list[DecisionTree] = field(default_factory=list)

    def fit(self, df: DataFrame) -> RandomForest:
        """All trees together, a job a level: a row goes to the trees in which its weight is not 0."""
        weight = lambda u: "case " + " ".join(f"when {u} < {num(c)} then {k}D" for k, c in enumerate(np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120)]))) + " else 6D end"
        draws = ", ".join(weight(draw(self.key, f"{self.seed}:{t}")) if self.bootstrap else "1D" for t in range(self.n_estimators))
        rows = df.select(*self.features, self.label, F.expr(f"array({draws})").alias("weights_"))
        rows, cuts, kept = prepared(rows, self.features, self.max_bins)
        classes = [r[0] for r in rows.select(self.label).distinct().orderBy(self.label).collect()] if self.task == "classification" else None
        own = lambda tree=None: DecisionTree(self.features, self.label, self.max_depth, self.min_samples_split, self.min_samples_leaf, self.criterion, self.task, self.max_bins, classes=classes, tree=tree)
        self.trees = [own(t) for t in own()._all(rows, cuts, "weights_", self.n_estimators)]
        for x in kept:
            x.unpersist()
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        votes = [t.leaf_expr() for t in self.trees]
        out = df.withColumn("votes_", F.expr(f"array({', '.join(votes)})"))
        return out.withColumns({f"p_{c}": F.expr(f"size(filter(votes_, v -> v = {c!r})) / {len(votes)}") for c in self.trees[0].classes}).drop("votes_")

    def predict(self, df: DataFrame) -> DataFrame:
        if self.task == "regression":
            return df.withColumn("prediction", F.expr("(" + " + ".join(t.leaf_expr() for t in self.trees) + f") / {len(self.trees)}"))
        classes = self.trees[0].classes
        p = [f"`p_{c}`" for c in classes]
        best = f"element_at(array({', '.join(map(repr, classes))}), cast(array_position(array({', '.join(p)}), array_max(array({', '.join(p)}))) as int))"
        return self.predict_proba(df).withColumn("prediction", F.expr(best)).drop(*[f"p_{c}" for c in classes])

    def score(self, df: DataFrame) -> float | None:
        return (metrics.accuracy if self.task == "classification" else metrics.r2)(self.predict(df), self.label)


@dataclass
class AdaBoost:
    """Stumps on labels -1 and 1; only missed rows gain weight (exp(alpha)), then weights are normalised."""

    features: list[str]
    label: str = "label"
    n_estimators: int = 50
    learning_rate: float = 1.0
    max_bins: int | None = 256
    stumps: list[tuple[int, float, int, float]] = field(default_factory=list)  # feature, threshold, polarity, alpha

    def _vote(self, s) -> str:
        f, t, p, _ = s
        return f"case when {self.features[f]} <= {num(t)} then {-p}D else {p}D end"

    def fit(self, df: DataFrame) -> AdaBoost:
        rows = complete(df, [*self.features, self.label]).select(*self.features, self.label)
        if metrics.first(rows.agg(F.count_if(~F.col(self.label).isin(-1, 1)))):
            raise ValueError("labels must be -1 or 1")
        rows, cuts, kept = prepared(rows, self.features, self.max_bins)
        rows, self.stumps = rows.withColumn("w_", F.lit(1.0)), []
        for k in range(self.n_estimators):
            total = metrics.first(rows.agg(F.sum("w_")))
            w = f"w_ / {num(total)}"
            stats = {"n": "1", "p": f"case when {self.label} > 0 then {w} else 0D end", "m": f"case when {self.label} < 0 then {w} else 0D end"}
            # Polarity 1 votes -1 on the left: it misses the left's positives and the right's negatives.
            tree = grow(rows, self.features, stats, "greatest(1 - (l_p + r_m), 1 - (l_m + r_p))", "true", lambda s: 0.0, 1, -1, cuts=cuts)
            if "feature" not in tree[0]:
                break
            left, right = tree[1]["stats"], tree[2]["stats"]
            miss = left["p"] + right["m"]
            polarity = 1 if miss <= left["m"] + right["p"] else -1
            e = min(max(min(miss, left["m"] + right["p"]), 1e-10), 1 - 1e-10)
            alpha = 0.5 * np.log((1 - e) / e) * self.learning_rate
            self.stumps.append((tree[0]["feature"], tree[0]["threshold"], polarity, float(alpha)))
            rows = rows.withColumn("w_", F.expr(f"{w} * case when ({self._vote(self.stumps[-1])}) <> {self.label} then {num(np.exp(alpha))} else 1D end"))
            if k % 5 == 4:
                rows = written(rows)
        for x in kept:
            x.unpersist()
        return self

    def _margin(self, n: int | None = None) -> str:
        return " + ".join(f"{num(s[3])} * ({self._vote(s)})" for s in self.stumps[:n]) or "0D"

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.expr(f"cast(signum({self._margin()}) as int)"))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", F.expr(sigmoid(f"2 * ({self._margin()}) / {num(sum(abs(s[3]) for s in self.stumps))}")))

    def score(self, df: DataFrame) -> float | None:
        return metrics.accuracy(self.predict(df), self.label)

    def staged_score(self, df: DataFrame) -> list[float]:
        return list(df.agg(*[F.expr(f"avg(case when signum({self._margin(k + 1)}) = {self.label} then 1D else 0D end)") for k in range(len(self.stumps))]).first())

    def get_feature_importance(self) -> dict[str, float]:
        total = sum(abs(s[3]) for s in self.stumps)
        return {f: sum(abs(s[3]) for s in self.stumps if s[0] == i) / total for i, f in enumerate(self.features)}

    def learners(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, self.features[f], t, p, a) for k, (f, t, p, a) in enumerate(self.stumps)], "learner int, feature string, threshold double, polarity int, alpha double")


@dataclass
class Boosting:
    """Boosted trees.  style: 'gradient' (variance gain, leaf = mean residual), 'newton' (first and second order,
    L1 and L2), 'histogram' (newton on percentile bins), 'oblivious' (one split a level for all leaves)."""

    features: list[str]
    label: str = "label"
    key: str = "id"
    style: str = "gradient"
    objective: str = "squared"  # squared, absolute (gradient only), logistic
    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 3
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    min_child_weight: float = 0.0
    gamma: float = 0.0
    reg_lambda: float = 0.0
    reg_alpha: float = 0.0
    subsample: float = 1.0
    bagging_freq: int = 1
    colsample: float = 1.0
    max_bins: int | None = 256
    random_strength: float = 0.0  # oblivious style: noise of split scores
    bundle: bool = False  # histogram style: features that exclude each other share a histogram entry
    num_leaves: int | None = None  # histogram style: the leaf of the greatest gain is split next, up to so many leaves
    seed: int = 0
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    history: list[float] = field(default_factory=list)
    bundles: list[list[int]] | None = None

    @classmethod
    def xgboost(cls, features, **kw) -> Boosting:
        return cls(features, **({"style": "newton", "learning_rate": 0.3, "max_depth": 6, "min_child_weight": 1.0, "reg_lambda": 1.0} | kw))

    @classmethod
    def lightgbm(cls, features, **kw) -> Boosting:
        return cls(features, **({"style": "histogram", "max_depth": 5, "min_samples_leaf": 20, "min_child_weight": 1e-3, "max_bins": 255} | kw))

    @classmethod
    def catboost(cls, features, **kw) -> Boosting:
        return cls(features, **({"style": "oblivious", "learning_rate": 0.03, "max_depth": 6, "reg_lambda": 3.0, "max_bins": 128} | kw))

    def _gradients(self) -> tuple[str, str]:
        p, y = sigmoid("m_"), self.label
        if self.objective == "logistic":
            return f"({p} - {y})", f"(({p}) * (1 - {p}))" if self.style in ("newton", "histogram") else "1D"
        if self.objective == "absolute":
            return f"signum(m_ - {y})", "1D"
        if self.objective != "squared":
            raise ValueError(f"unknown objective {self.objective!r}")
        return f"(m_ - {y})", "1D"

    def _loss(self) -> str:
        y = self.label
        if self.objective == "logistic":
            p = f"least(greatest({sigmoid('m_')}, 1e-15D), 1 - 1e-15D)"
            return f"-avg({y} * ln({p}) + (1 - {y}) * ln(1 - {p}))"
        return f"avg(abs(m_ - {y}))" if self.objective == "absolute" else f"avg(pow(m_ - {y}, 2))"

    def _leaf(self, s: dict) -> float:
        g = np.sign(s["g"]) * max(abs(s["g"]) - self.reg_alpha, 0)
        return -g / (s["h"] + self.reg_lambda + 1e-10) if self.style in ("newton", "histogram") else -s["g"] / (s["n"] + self.reg_lambda) if s["n"] else 0.0

    def _tree(self, rows: DataFrame, cuts, columns) -> Tree:
        g, h = self._gradients()
        stats = {"n": "1D", "g": g, "h": h}
        if self.style == "oblivious":
            return self._oblivious(rows, stats, cuts, len(self.trees))
        if self.style == "gradient":
            gain = "(pow(l_g, 2) / l_n + pow(r_g, 2) / r_n - pow(t_g, 2) / t_n) / t_n"
        else:
            soft = lambda s: f"pow(greatest(abs({s}_g) - {num(self.reg_alpha)}, 0D), 2) / ({s}_h + {num(self.reg_lambda)} + 1e-10D)"
            gain = f"0.5D * ({soft('l')} + {soft('r')} - {soft('t')}) - {num(self.gamma)}"
        valid = f"l_n >= {self.min_samples_leaf} and r_n >= {self.min_samples_leaf} and l_h >= {num(self.min_child_weight)} and r_h >= {num(self.min_child_weight)}"
        return grow(rows, self.features, stats, gain, valid, self._leaf, self.max_depth, 1e-12, lambda s: s["n"] >= self.min_samples_split, cuts, columns, self.num_leaves, self.bundles)

    def _oblivious(self, rows: DataFrame, stats: dict[str, str], cuts, t: int = 0) -> Tree:
        """Sums by leaf, feature and bin come to the driver: at most 2^depth * features * bins numbers.

        With random_strength, the score of a split gets normal noise of that many parts of the root of the mean squared
        gradient, less from tree to tree.
        """
        rng, noise = np.random.default_rng([self.seed, t]), 0.0
        if self.random_strength:
            noise = self.random_strength * float(metrics.first(rows.agg(F.expr(f"sqrt(avg(pow({stats['g']}, 2)))"))) or 0.0) * np.exp(-self.learning_rate * t)
        tree: Tree = {0: {"stats": {}, "value": 0.0}}
        leaves = [0]
        for _ in range(self.max_depth):
            at = compile_tree(tree, self.features, str)
            bins = ", ".join(f"struct({f} as f, cast({self.features[f] if isinstance(cuts[f], Values) else f'b_{f}'} as double) as b)" for f in range(len(self.features)))
            sums = rows.select(F.expr(at).alias("leaf"), *[F.expr(e).alias(k) for k, e in stats.items()], F.explode(F.expr(f"array({bins})")).alias("c")).groupBy("leaf", "c.f", "c.b").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).collect()
            best = (1e-12, None)
            for f in range(len(self.features)):
                grid = np.zeros((2, len(leaves), len(cuts[f]) + 1))
                for r in sums:
                    if r["f"] == f:
                        grid[:, leaves.index(r["leaf"]), int(np.searchsorted(cuts[f], r["b"]) if isinstance(cuts[f], Values) else r["b"])] += r["n"], r["g"]
                left = grid.cumsum(2)[:, :, :-1]
                right = grid.sum(2, keepdims=True) - left
                score = lambda x: np.divide(x[1] ** 2, x[0] + self.reg_lambda, out=np.zeros_like(x[1]), where=x[0] + self.reg_lambda > 0)
                gains = (score(left) + score(right) - score(grid.sum(2, keepdims=True))).sum(0)
                gains = gains + noise * rng.standard_normal(len(gains)) if noise else gains
                if len(gains) and round(gains.max(), 12) > best[0]:
                    best = (round(float(gains.max()), 12), (f, cuts[f][int(gains.argmax())]))
            if best[1] is None:
                break
            for n in leaves:
                tree[n] |= {"feature": best[1][0], "threshold": best[1][1], "gain": best[0]}
                tree[2 * n + 1], tree[2 * n + 2] = {"stats": {}, "value": 0.0}, {"stats": {}, "value": 0.0}
            leaves = [c for n in leaves for c in (2 * n + 1, 2 * n + 2)]
        for r in rows.select(F.expr(compile_tree(tree, self.features, str)).alias("leaf"), *[F.expr(e).alias(k) for k, e in stats.items()]).groupBy("leaf").agg(*[F.sum(k).alias(k) for k in stats]).collect():
            tree[r["leaf"]]["stats"] = {k: r[k] for k in stats}
            tree[r["leaf"]]["value"] = self._leaf(tree[r["leaf"]]["stats"])
        return tree

    def fit(self, df: DataFrame, evaluation: DataFrame | None = None, early_stopping_rounds: int | None = None) -> Boosting:
        also = {"mean": F.avg(self.label)}
        rows, cuts, kept = prepared(df.select(self.key, *self.features, self.label), self.features, self.max_bins, also=also, checked=[*self.features, self.label])
        mean = also["mean"]
        clipped = min(max(mean, 1e-15), 1 - 1e-15)
        self.base = float(np.log(clipped / (1 - clipped)) if self.objective == "logistic" else mean)
        self.trees, self.history = [], []
        return self._boost(rows.withColumn("m_", F.lit(self.base)), cuts, kept, self.n_estimators, evaluation, early_stopping_rounds)

    def update(self, df: DataFrame, n_trees: int = 10) -> Boosting:
        """Adds trees that are fitted on new rows, from the margins that the model has for them; its own trees stay."""
        rows, cuts, kept = prepared(df.select(self.key, *self.features, self.label), self.features, self.max_bins, checked=[*self.features, self.label])
        return self._boost(self._margins(rows), cuts, kept, n_trees)

    def _margins(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("m_", F.lit(self.base))
        for tree in self.trees:
            rows = stepped(rows, tree, self.features, "m_", self.learning_rate)
        return rows

    def _boost(self, rows: DataFrame, cuts, kept: list[DataFrame], n_trees: int, evaluation: DataFrame | None = None, early_stopping_rounds: int | None = None) -> Boosting:
        """Adds trees to rows with margins m_; kept is let go at the end."""
        if self.bundle:
            self.bundles = exclusive_bundles(rows, self.features, cuts)
        held = self._margins(evaluation) if evaluation is not None else None
        best, older, first = (float("inf"), 0), rows.limit(0), len(self.trees)
        if first:
            rows = rows.persist()
        for t in range(first, first + n_trees):
            own = rows
            if self.subsample < 1 and t % self.bagging_freq == 0:
                own = rows.where(F.expr(f"{draw(self.key, f'{self.seed}:{t}')} < {self.subsample}D")).persist()
            rng = np.random.default_rng(self.seed + t)
            columns = None if self.colsample >= 1 else sorted(rng.choice(len(self.features), max(1, int(self.colsample * len(self.features))), replace=False).tolist())
            tree = self._tree(own, cuts, columns)
            self.trees.append(tree)
            if own is not rows:
                own.unpersist()
            if t == first + n_trees - 1 and held is None:
                break
            # The next tree fills the new rows from the last ones, which are let go one tree later.
            older.unpersist()
            older, rows = rows, stepped(rows, tree, self.features, "m_", self.learning_rate)
            rows = written(rows) if t % 5 == 4 else rows.persist()
            if held is not None:
                held = stepped(held, tree, self.features, "m_", self.learning_rate)
                held = written(held) if t % 5 == 4 else held
                self.history.append(metrics.first(held.agg(F.expr(self._loss()))))
                if self.history[-1] < best[0]:
                    best = (self.history[-1], t)
                elif early_stopping_rounds and t - best[1] >= early_stopping_rounds:
                    self.trees = self.trees[: best[1] + 1]
                    break
        for x in (older, rows, *kept):
            x.unpersist()
        return self

    def margin(self, n: int | None = None) -> str:
        return " + ".join([num(self.base), *(f"{num(self.learning_rate)} * ({compile_tree(t, self.features)})" for t in self.trees[:n])])

    def predict(self, df: DataFrame, num_iteration: int | None = None) -> DataFrame:
        m = self.margin(num_iteration)
        return df.withColumn("prediction", F.expr(sigmoid(f"({m})") if self.objective == "logistic" else m))

    def predict_proba(self, df: DataFrame, num_iteration: int | None = None) -> DataFrame:
        if self.objective != "logistic":
            raise ValueError("probabilities need the logistic objective")
        return self.predict(df, num_iteration).select("*", F.expr("1 - prediction").alias("p_0"), F.col("prediction").alias("p_1")).drop("prediction")

    def staged_predict(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"stage_{k + 1}": F.expr(sigmoid(f"({self.margin(k + 1)})") if self.objective == "logistic" else self.margin(k + 1)) for k in range(len(self.trees))})

    def staged_score(self, df: DataFrame) -> list[float]:
        out = []
        for k in range(len(self.trees)):
            p = self.predict(df, k + 1)
            out.append(metrics.accuracy(p.withColumn("c_", (F.col("prediction") >= 0.5).cast("int")), self.label, "c_") if self.objective == "logistic" else metrics.r2(p, self.label))
        return out

    def score(self, df: DataFrame) -> float | None:
        """Accuracy, R2, or for the oblivious style -RMSE."""
        p = self.predict(df)
        if self.objective == "logistic":
            return metrics.accuracy(p.withColumn("c_", (F.col("prediction") >= 0.5).cast("int")), self.label, "c_")
        return -metrics.rmse(p, self.label) if self.style == "oblivious" else metrics.r2(p, self.label)

    def get_feature_importance(self, kind: str = "weight") -> dict[str, float]:
        """weight (number of splits), gain or cover (means of a split), normalised."""
        own = [[n for t in self.trees for n in splits(t) if n["feature"] == i] for i in range(len(self.features))]
        value = {"weight": len, "gain": lambda x: float(np.mean([n["gain"] for n in x])) if x else 0.0, "cover": lambda x: float(np.mean([n["stats"].get("h", 0) for n in x])) if x else 0.0}[kind]
        raw = [value(x) for x in own]
        return {f: v / (sum(raw) or 1) for f, v in zip(self.features, raw)}


@dataclass
class LambdaRank:
    """Boosted trees on lambda gradients of NDCG over all pairs of a query with different relevance; compat keeps
    only pairs that the scores order wrongly, with ties skipped."""

    features: list[str]
    relevance: str = "rel"
    query: str = "qid"
    key: str = "id"
    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    min_samples_split: int = 10
    subsample: float = 0.7
    compat: bool = False
    seed: int = 0
    max_bins: int | None = 64
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def lambdas(self, rows: DataFrame) -> DataFrame:
        """(key, g): the sums of a row's pair gradients; a self-join within queries."""
        q, k, y = self.query, self.key, self.relevance
        ranked = rows.select(q, k, y, "m_", F.row_number().over(Window.partitionBy(q).orderBy(F.desc("m_"), k)).alias("p"), F.row_number().over(Window.partitionBy(q).orderBy(F.desc(y), k)).alias("b"))
        ideal = ranked.groupBy(q).agg(F.expr(f"sum((pow(2, {y}) - 1) / log2(b + 1))").alias("ideal"))
        pairs = ranked.alias("l").join(ranked.alias("r"), F.expr(f"l.{q} = r.{q} and l.{y} > r.{y}" + (" and l.m_ < r.m_" if self.compat else ""))).join(ideal.alias("i"), F.expr(f"i.{q} = l.{q} and i.ideal > 0"))
        s = sigmoid("(r.m_ - l.m_)")
        delta = f"abs((pow(2, l.{y}) - pow(2, r.{y})) * (1 / log2(l.p + 1) - 1 / log2(r.p + 1))) / i.ideal"
        found = pairs.select(F.expr(f"l.{k}").alias("u"), F.expr(f"r.{k}").alias("v"), F.expr(f"{delta} * {s}" + (f" * (1 - {s})" if self.compat else "")).alias("g"))
        return found.select(F.expr("stack(2, u, -g, v, g) as (k_, g)")).groupBy("k_").agg(F.sum("g").alias("g_"))

    def fit(self, df: DataFrame) -> LambdaRank:
        also = {"mean": F.avg(self.relevance)}
        rows, cuts, kept = prepared(df.select(self.query, self.key, self.relevance, *self.features), self.features, self.max_bins, also=also, checked=[*self.features, self.relevance])
        self.base, self.trees = float(also["mean"]), []
        return self._boost(rows.withColumn("m_", F.lit(self.base)), cuts, kept, self.n_estimators)

    def update(self, df: DataFrame, n_trees: int = 10) -> LambdaRank:
        """Adds trees that are fitted on new queries, from the scores that the model has for them; its own trees stay."""
        rows, cuts, kept = prepared(df.select(self.query, self.key, self.relevance, *self.features), self.features, self.max_bins, checked=[*self.features, self.relevance])
        rows = rows.withColumn("m_", F.lit(self.base))
        for tree in self.trees:
            rows = stepped(rows, tree, self.features, "m_", self.learning_rate)
        return self._boost(rows, cuts, kept, n_trees)

    def _boost(self, rows: DataFrame, cuts: list[list[float]] | None, kept: list[DataFrame], n_trees: int) -> LambdaRank:
        rows = written(rows)
        for x in kept:
            x.unpersist()
        for _ in range(n_trees):
            self.trees.append(self._tree(rows, cuts, len(self.trees)))
            last, rows = rows, written(stepped(rows, self.trees[-1], self.features, "m_", self.learning_rate))
            removed(last)
        removed(rows)
        return self

    def _tree(self, rows: DataFrame, cuts: list[list[float]] | None, t: int) -> Tree:
        own = rows.join(self.lambdas(rows), F.col(self.key) == F.col("k_"), "left").withColumn("g_", F.coalesce("g_", F.lit(0.0))).where(F.expr(f"{draw(self.key, f'{self.seed}:{t}')} < {self.subsample}D")).persist()
        tree = grow(own, self.features, {"n": "1D", "g": "g_"}, "(pow(l_g, 2) / l_n + pow(r_g, 2) / r_n - pow(t_g, 2) / t_n) / t_n", "l_n >= 2 and r_n >= 2", lambda s: -s["g"] / s["n"] if s["n"] else 0.0, self.max_depth, -1, lambda s: s["n"] >= self.min_samples_split, cuts)
        own.unpersist()
        return tree

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", F.expr(" + ".join([num(self.base), *(f"{num(self.learning_rate)} * ({compile_tree(t, self.features)})" for t in self.trees)])))

    def rank(self, df: DataFrame) -> DataFrame:
        return self.predict(df).withColumn("rank", F.row_number().over(Window.partitionBy(self.query).orderBy(F.desc("score"), self.key)))

    def evaluate(self, df: DataFrame, k: int = 10) -> DataFrame:
        return metrics.ndcg(self.predict(df), self.query, self.relevance, "score", self.key, k)
