import re

from millrace.functions import prepare


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_within_their_key(spark):
    rows = spark.createDataFrame([(1, "The cat, the cat http://x.y/z sat", "en"), (1, "sat down", None), (2, None, "en"), (None, "down", "de")], "k int, text string, lang string")
    found = prepare.terms(rows, "k", "text", 2, beside="lang")
    assert "term" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", plan(found)))  # texts are dealt out, their terms are not
    assert sorted((r["k"] or 0, r["term"], r["cnt"], *r["lang"]) for r in found.collect()) == sorted(
        [(1, "the", 2, "en"), (1, "cat", 2, "en"), (1, "sat", 2, "en"), (1, "down", 1, "en"), (1, "the cat", 2, "en"), (1, "cat the", 1, "en"), (1, "cat sat", 1, "en"), (1, "sat down", 1, "en"), (0, "down", 1, "de")]
    )
    assert {r["term"] for r in prepare.terms(rows, "k", "text", 1, ("the",)).collect()} == {"cat", "sat", "down"}
