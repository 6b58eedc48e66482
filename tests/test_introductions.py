import numpy as np
import pyarrow as pa
import pytest

from millrace.operators import descent
from millrace.operators.clustering import distances


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_lists_of_one_length_are_introduced_together(monkeypatch, metric):
    rng = np.random.default_rng(2)
    lists = [[{"j": int(j), "x": rng.normal(size=3).tolist(), "new": bool(rng.integers(2)), "worst": float(rng.choice([1.0, np.inf]))} for j in rng.choice(40, n)] for n in [5] * 300 + [1, 2, 0, 7]]
    kind = pa.list_(pa.struct([("j", pa.int64()), ("x", pa.list_(pa.float64())), ("new", pa.bool_()), ("worst", pa.float64())]))
    calls = []
    monkeypatch.setattr(descent, "_among", lambda x, m, f=descent._among: calls.append(len(x)) or f(x, m))
    (found,) = descent._introduced(2, metric)(iter([pa.record_batch([pa.array(lists, kind)], names=["members"])]))
    want = []
    for own in lists:
        d = distances(*[np.array([m["x"] for m in own]).reshape(len(own), 3)] * 2, metric)
        for a, m in enumerate(own):
            near = sorted((d[a, b], b) for b, o in enumerate(own) if o["j"] != m["j"] and d[a, b] < m["worst"] and (m["new"] or o["new"]))
            want += [(m["j"], own[b]["j"], round(x, 9)) for x, b in near[:2]]
    assert sorted((i, j, round(d, 9)) for i, j, d in zip(*(found.column(c).to_pylist() for c in "ijd"))) == sorted(want)
    assert calls == [1, 300, 1]
