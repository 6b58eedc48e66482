import re

from millrace.operators.sequences import TopicModel


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topic_weights_are_compiled_and_documents_dealt_once(spark):
    counts = spark.createDataFrame([(d, t, 1 + (d + len(t)) % 3) for d in range(12) for t in ("a", "bb", "ccc", "dddd")], "doc long, term string, cnt long")
    m = TopicModel(3, max_iter=1)
    m.fit(counts)
    tokens = m._start(counts)
    found = plan(m._sweep(tokens, m._counts(tokens, "term", "tn"), m._counts(tokens, "", "al"), 0))
    assert "lambda" not in found and "aggregate(" not in found
    assert len(re.findall(r"hashpartitioning\(doc", found)) == 1
    assert m.transform(counts, 2).count() == 12
