from pyspark.sql import functions as F

from millrace.functions import prepare
from millrace.operators import ranking


def test_coherence_reads_all_counts_twice_at_most(spark):
    rows = spark.range(40).select("id", F.expr("concat_ws(' ', 'aaaa', if(id % 2 = 0, 'bbbb', 'cccc'))").alias("text"))
    read = spark.sparkContext.accumulator(0)

    def passed(parts):
        for part in parts:
            read.add(len(part))
            yield part

    counts = prepare.terms(rows, "id", "text").withColumnRenamed("id", "doc").mapInPandas(passed, "doc long, term string, cnt long")
    top = spark.createDataFrame([(0, "aaaa"), (0, "bbbb"), (0, "cccc")], "topic int, term string")
    assert round(ranking.coherence(counts, top).first()["coherence"], 9) == round((0 + 0 - 1) / 3, 9)
    assert read.value == 160
