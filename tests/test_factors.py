"""Implicit and social factorization, and block products, against plain numpy."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import factors
from millrace.operators.embedding import MatrixFactorization
from millrace.operators.factors import ImplicitFactorization, best_products


@pytest.fixture(scope="module")
def strengths(spark):
    rng = np.random.default_rng(4)
    rows = [(int(u), f"i{i}", float(rng.integers(1, 9))) for u in range(40) for i in range(25) if rng.random() < 0.25]
    rows += [(999, f"i{i}", 1.0) for i in range(25)]  # a user of all items
    return spark.createDataFrame(rows, "user long, item string, rating double").repartition(5)


def plain_als(rows, start, d, ridge, alpha, sweeps):
    users, items = sorted({r[0] for r in rows}), sorted(start)
    r = np.zeros((len(users), len(items)))
    for u, i, x in rows:
        r[users.index(u), items.index(i)] += x
    c, p = 1 + alpha * r, (r > 0).astype(float)
    v, u = np.array([start[i] for i in items]), None
    losses = []
    for _ in range(sweeps):
        u = np.array([np.linalg.solve(v.T @ np.diag(c[k]) @ v + ridge * np.eye(d), v.T @ (c[k] * p[k])) for k in range(len(users))])
        v = np.array([np.linalg.solve(u.T @ np.diag(c[:, k]) @ u + ridge * np.eye(d), u.T @ (c[:, k] * p[:, k])) for k in range(len(items))])
        losses.append((c * (p - u @ v.T) ** 2).sum() + ridge * ((u**2).sum() + (v**2).sum()))
    return users, items, u, v, losses


def test_implicit_factors_and_their_uses(spark, strengths):
    m = ImplicitFactorization(3, 0.2, 5.0, 0).fit(strengths)
    start = {r["item"]: r["f"] for r in m.items.collect()}
    m = ImplicitFactorization(3, 0.2, 5.0, 4).fit(strengths)
    rows = [tuple(r) for r in strengths.collect()]
    users, items, u, v, losses = plain_als(rows, start, 3, 0.2, 5.0, 4)
    assert np.allclose(m.losses, losses) and all(a >= b - 1e-9 for a, b in zip(m.losses, m.losses[1:]))
    got = {r["user"]: r["f"] for r in m.users.collect()}
    assert np.allclose([got[k] for k in users], u)
    # Held out, unknown and known pairs.
    asked = spark.createDataFrame([(0, "i3"), (999, "i0"), (5, "new"), (None, "i1")], "user long, item string")
    found = {(r["user"], r["item"]): r["prediction"] for r in m.predict(asked).collect()}
    assert np.isclose(found[0, "i3"], u[users.index(0)] @ v[items.index("i3")]) and found[5, "new"] is None and found[None, "i1"] is None
    # A user's own strengths, folded in for fixed items, give the solution of its equations.
    folded = {r["user"]: r["f"] for r in m.fold_in(spark.createDataFrame([(7, i, x) for k, i, x in rows if k == 0], "user long, item string, rating double")).collect()}
    c = np.array([1 + 5.0 * sum(x for k, i, x in rows if k == 0 and i == n) for n in items])
    assert np.allclose(folded[7], np.linalg.solve(v.T @ np.diag(c) @ v + 0.2 * np.eye(3), v.T @ (c * (c > 1))))
    # Percentile rank of the strengths themselves: those of chance are at 0.5.
    s = u @ v.T
    want = sum(x * (s[users.index(k)] > s[users.index(k), items.index(i)]).sum() / (len(items) - 1) for k, i, x in rows) / sum(x for *_, x in rows)
    assert np.isclose(m.mean_percentile_rank(strengths), want) and want < 0.4


def test_strengths_that_say_nothing(spark):
    odd = spark.createDataFrame([(1, 1, 2.0), (1, 1, 1.0), (1, 2, 0.0), (1, 3, -2.0), (2, 2, None), (None, 2, 1.0), (2, None, 1.0), (3, 4, 1.0)], "user long, item long, rating double")
    m = ImplicitFactorization(2, n_epochs=2).fit(odd)
    assert {(r["user"], r["item"], r["rating"]) for r in m.ratings.collect()} == {(1, 1, 3.0), (3, 4, 1.0)}
    assert {r["user"] for r in m.users.collect()} == {1, 3} and m.recommend(odd.select("user").where("user = 1"), 9).count() == 1
    none = ImplicitFactorization(2, n_epochs=1).fit(odd.limit(0))
    assert none.users.count() == 0 and none.losses == [0.0]


@pytest.mark.parametrize("block", [7, 2048])
def test_best_products_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(factors, "BLOCK", block)
    rng = np.random.default_rng(8)
    x, y = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (30, 3)).astype(float)  # many ties
    users = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "user long, x array<double>")
    items = spark.createDataFrame([(f"n{j:02d}", y[j].tolist()) for j in range(30)], "item string, x array<double>")
    without = [(int(u), f"n{i:02d}") for u, i in rng.integers(0, 35, (200, 2))] + [(3, f"n{j:02d}") for j in range(30)] + [(77, "n01"), (1, "zz")]
    for low, high in ((None, None), (-1.0, 3.0)):
        got = best_products(users, items, 4, spark.createDataFrame(without, "user long, item string"), low, high)
        s = x @ y.T if low is None else np.clip(x @ y.T, low, high)
        gone = set(without)
        want = {(i, f"n{j:02d}", s[i, j], k + 1) for i in range(40) for k, j in enumerate(sorted((j for j in range(30) if (i, f"n{j:02d}") not in gone), key=lambda j: (-s[i, j], j))[:4])}
        assert {tuple(r) for r in got.select("user", "item", "prediction", "rank").collect()} == want and len(want) == 156
    assert best_products(users, items.limit(0), 4).count() == 0


def test_friends_come_together(spark):
    rng = np.random.default_rng(2)
    ratings = spark.createDataFrame([(int(u), int(i), float(rng.integers(1, 6))) for u in range(30) for i in rng.choice(12, 5, replace=False)], "user long, item long, rating double")
    edges = spark.createDataFrame([(k, (k + 1) % 10) for k in range(10)] + [(3, 3), (5, 99), (1, 0)], "user long, friend long")
    apart = []
    for social in (0.0, 20.0):
        m = MatrixFactorization(4, learning_rate=0.02, n_epochs=6, init_std=1.0, social=social).fit(ratings, edges)
        u = {r["user"]: np.array(r["u"]) for r in m.users.collect()}
        apart.append(np.mean([((u[k] - u[(k + 1) % 10]) ** 2).sum() for k in range(10)]))
    alone = MatrixFactorization(4, learning_rate=0.02, n_epochs=6, init_std=1.0).fit(ratings)
    assert np.allclose(alone.losses, MatrixFactorization(4, learning_rate=0.02, n_epochs=6, init_std=1.0).fit(ratings, edges).losses)
    assert apart[1] < apart[0] / 3


def test_recommendations_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(factors, "BLOCK", 5)
    rng = np.random.default_rng(6)
    ratings = spark.createDataFrame([(int(u), int(i), float(rng.integers(1, 6))) for u in range(14) for i in rng.choice(12, 5, replace=False)], "user long, item long, rating double")
    m = MatrixFactorization(3, n_epochs=2, init_std=1.0).fit(ratings)
    for exclude in (True, False):
        pairs = m.users.select("user").crossJoin(m.items.select("item"))
        pairs = pairs.join(ratings.select("user", "item"), ["user", "item"], "left_anti") if exclude else pairs
        want = {}
        for r in m.predict(pairs).collect():
            want.setdefault(r["user"], []).append((-round(r["prediction"], 9), r["item"]))
        got = {}
        for r in m.recommend(ratings.select("user"), 3, exclude).orderBy("user", "rank").collect():
            got.setdefault(r["user"], []).append((-round(r["prediction"], 9), r["item"]))
        assert got == {u: sorted(x)[:3] for u, x in want.items()}


def test_loops_leave_only_their_results(spark, strengths):
    count = lambda: len(glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file:')}/loop/*"))
    before = count()
    m = ImplicitFactorization(2, n_epochs=3).fit(strengths)
    assert count() == before + 3  # ratings, users, items
    m = MatrixFactorization(2, n_epochs=3).fit(strengths.where(F.col("rating") < 6))
    assert count() == before + 6 and m.users.count() > 0
