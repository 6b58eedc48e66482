"""Re-ranking for diversity, clicks by position, coherence of topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import array_distance, num
from .loop import written


def diversify(df: DataFrame, query: str, key: str, score: str, vector: str, k: int = 10, relevance: float = 0.5) -> DataFrame:
    """(query, key, rank): the first k of each query by maximal marginal relevance, relevance * score - (1 - relevance) *
    greatest cosine to those chosen, ties by key; the first is the best score.  A round is one grouped max and one join on the
    query for all queries at once, so no group comes to one task whole."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = df.select(query, key, F.col(score).cast("double").alias("s_"), F.col(vector).alias("v_"), F.lit(None).cast("double").alias("near_"))
    chosen = None
    for rank in range(1, k + 1):
        value = "s_" if rank == 1 else f"{num(relevance)} * s_ - {num(1 - relevance)} * near_"
        # The least key among the greatest values: a map-side max of (value, key) would take the greatest.
        best = rows.groupBy(query).agg(F.max(F.expr(value)).alias("top_"))
        best = rows.join(best, query).where(F.expr(f"{value} = top_")).groupBy(query).agg(F.expr(f"min_by(struct({key} as k_, v_ as p_), {key})").alias("b_")).select(query, "b_.*")
        best = written(best)
        own = best.select(query, F.col("k_").alias(key), F.lit(rank).alias("rank"))
        chosen = own if chosen is None else chosen.unionByName(own)
        if rank < k:
            near = "1 - (" + array_distance("v_", "p_", "cosine") + ")"
            rows = written(rows.join(best, query).where(F.col(key) != F.col("k_")).withColumn("near_", F.greatest("near_", F.expr(near))).drop("k_", "p_"))
    return chosen


def position_weights(df: DataFrame, clicks: str, position: str) -> DataFrame:
    """df with adjusted_clicks: clicks over the chance 1 / log2(position + 2) that a place (from 0) is looked at."""
    return df.withColumn("adjusted_clicks", F.col(clicks) * F.log2(F.col(position) + 2))


def coherence(counts: DataFrame, top: DataFrame) -> DataFrame:
    """(topic, coherence): mean normalised pointwise mutual information of the pairs of a topic's words, by documents.

    counts: (doc, term, ...), one row a pair; top: (topic, term), a few words a topic, so pairs within a document are bounded by
    the words of its topics, not by its length.  A pair that never meets counts -1, one that is in all documents 1.
    """
    n_docs = counts.select("doc").distinct().count()
    words = written(top.select("topic", "term").distinct())
    # Only the rows of these words go on: each table below reads them, not all counts again.
    few = written(counts.select("doc", "term").join(F.broadcast(words.select("term").distinct()), "term", "left_semi"))
    hits = few.join(F.broadcast(words), "term")
    single = few.groupBy("term").agg(F.count("*").alias("n"))
    both = hits.alias("x").join(hits.alias("y"), F.expr("x.doc = y.doc and x.topic = y.topic and x.term < y.term")).groupBy(F.col("x.topic").alias("topic"), F.col("x.term").alias("a"), F.col("y.term").alias("b")).agg(F.count("*").alias("nab"))
    pairs = words.alias("x").join(words.alias("y"), F.expr("x.topic = y.topic and x.term < y.term")).select(F.col("x.topic").alias("topic"), F.col("x.term").alias("a"), F.col("y.term").alias("b"))
    full = pairs.join(both, ["topic", "a", "b"], "left").join(single.select(F.col("term").alias("a"), F.col("n").alias("na")), "a", "left").join(single.select(F.col("term").alias("b"), F.col("n").alias("nb")), "b", "left")
    p = f"(nab / {num(max(n_docs, 1))})"
    npmi = f"case when nab is null then -1D when {p} >= 1 then 1D else ln({p} / (na * nb / {num(float(max(n_docs, 1)) ** 2)})) / -ln({p}) end"
    return full.groupBy("topic").agg(F.avg(F.expr(npmi)).alias("coherence"))


def ranked(df: DataFrame, query: str, score: str, key: str) -> DataFrame:
    """df with position, from 0, within the query by descending score, ties by key."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), key)) - 1)
