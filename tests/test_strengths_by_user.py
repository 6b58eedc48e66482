from pyspark.sql import functions as F

from millrace.operators.factors import ImplicitFactorization


def rows(spark):
    return spark.range(3000).select((F.col("id") % 50).alias("user"), (F.col("id") * 7 % 31).alias("item"), (F.col("id") % 5 + 1).cast("double").alias("rating"))


def test_strengths_of_a_user_lie_in_one_file(spark):
    m = ImplicitFactorization(2, n_epochs=1).fit(rows(spark))
    files = m.ratings.select("user", F.input_file_name().alias("f")).distinct().groupBy("user").count()
    assert files.agg(F.max("count")).first()[0] == 1
