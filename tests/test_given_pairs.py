import numpy as np

from millrace.operators import factors


def test_users_meet_only_boxes_that_can_hold_their_best(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, v = rng.normal(size=(30, 2)), rng.normal(size=(3000, 2))
    users = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "user long, x array<double>")
    items = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(v)], "item long, x array<double>")
    s = x @ v.T
    gone = [(u, int(i)) for u in range(30) for i in np.argsort(-s[u])[:70]]  # more than a box holds
    without = spark.createDataFrame([*gone, (99, 1), (2, None)], "user long, item long")
    found = factors.best_products(users, items, 3, without)
    got = {(r["user"], r["rank"]): r["item"] for r in found.collect()}
    assert got == {(u, k + 1): int(i) for u in range(30) for k, i in enumerate(np.argsort(-s[u])[70:73])}
    assert "given" in found._jdf.queryExecution().executedPlan().toString()  # a row a user, not a pair
    assert max(map(len, factors._boxes(v, 64))) <= 64 and sorted(np.concatenate(factors._boxes(v, 64)).tolist()) == list(range(3000))
