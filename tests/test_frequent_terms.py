"""The topic model with few, all or no terms in all tasks: the same topics; tokens of frequent terms are not dealt by term."""

import glob
import re

import pytest

from millrace.operators import sequences
from millrace.operators.sequences import TopicModel


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(d, f"t{k}", 1 + (d * k) % 3) for d in range(30) for k in range(40) if (d * 7 + k * k) % (k + 2) == 0]
    return spark.createDataFrame(rows + [(None, "t1", 2), (3, None, 1), (4, "t9", 0), (5, "gone", -1), (6, "t5", None)], "doc long, term string, cnt long").repartition(3)


def plain(m, counts):
    """Sweeps that deal all tokens by term."""
    tokens = m._start(counts)
    for t in range(m.max_iter):
        tokens = m._sweep(tokens, m._counts(tokens, "term", "tn"), m._counts(tokens, "", "al"), t)
    return {r["term"]: r["tn"] for r in m._counts(tokens, "term", "tn").collect()}


def test_same_topics_whatever_terms_are_frequent(spark, counts, monkeypatch):
    count = lambda: len(glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file:')}/loop/*"))
    found = []
    for n in (0, 6, 100):
        monkeypatch.setattr(sequences, "FREQUENT", n)
        before = count()
        m = TopicModel(3, max_iter=3).fit(counts)
        assert count() == before + 2  # the last tokens and the topics
        found.append({r["term"]: r["phi"] for r in m.topics.collect()})
    n_ = counts.select("term").distinct().count()
    assert m.n_terms == n_ and found[0] == found[1] == found[2]
    tn = plain(m, counts)
    al = [sum(v[i] for v in tn.values()) for i in range(3)]
    assert tn.keys() == found[0].keys()
    for t, v in tn.items():
        assert found[0][t] == pytest.approx([(n + 0.01) / (a + 0.01 * n_) for n, a in zip(v, al)])


def test_tokens_of_frequent_terms_are_dealt_by_document_alone(spark, counts, monkeypatch):
    m = TopicModel(3, max_iter=1)
    m.fit(counts)
    kept, sweep = [], TopicModel._sweep
    monkeypatch.setattr(TopicModel, "_sweep", lambda self, *a: kept.append(sweep(self, *a)) or kept[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m.fit(counts)
        found = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Above the window the counts of frequent terms come by a broadcast; by term only what is not of those is dealt.
    top = found[: found.index("Window")]
    assert re.search(r"Join LeftOuter.*rightHint=\(strategy=broadcast\)", top) and "Join Inner" not in top.replace("Join Inner, rightHint=(strategy=broadcast)", "")
