import numpy as np

from millrace.operators.sequences import HiddenMarkov, _lse, _Steps


def test_sequences_of_a_batch_step_together(spark):
    rng = np.random.default_rng(3)
    m = HiddenMarkov(["a", "b", "c"], ["x", "y"], seed=4)
    rows = [(i, None if i == 5 else [str(s) for s in rng.choice(["x", "y", "z"], n)]) for i, n in enumerate([3, 1, 40, 0, 7, 2, 7, 1])]
    df = spark.createDataFrame(rows, "seq_id int, symbols array<string>")
    pi, a, b, code = m._logs()
    want, paths = {}, {}
    for i, o in rows:
        if o:
            o = [code.get(s, 2) for s in o]
            al, best, back = [pi + b[:, o[0]]], pi + b[:, o[0]], []
            for x in o[1:]:
                al.append(b[:, x] + _lse(al[-1][:, None] + a, 0))
                back.append((best[:, None] + a).argmax(0))
                best = (best[:, None] + a).max(0) + b[:, x]
            path = [int(best.argmax())]
            for came in reversed(back):
                path.append(int(came[path[-1]]))
            want[i], paths[i] = np.array(al), ([m.states[s] for s in reversed(path)], round(float(best.max()), 9))
    got = {r["seq_id"]: np.array(r["alpha"]) for r in m.forward(df).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)
    assert {r["seq_id"]: (r["path"], round(r["log_probability"], 9)) for r in m.predict(df).collect()} == paths
    assert np.allclose([r["log_likelihood"] for r in m.score(df).orderBy("seq_id").collect()], [_lse(want[i][-1], 0) for i in sorted(want)])
    back = {r["seq_id"]: np.array(r["beta"]) for r in m.backward(df).collect()}
    assert all(np.allclose(_lse(want[i] + back[i], 1), _lse(want[i][-1], 0)) for i in want)
    assert len(_Steps([np.zeros(n, int) for n in (4, 9, 9)]).n) == 9  # as many steps as the longest, not 22
