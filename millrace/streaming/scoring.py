"""Fitted models over streams: predictions are columns, so they need no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, predict: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends predict(stream) to a Parquet folder; restarts go on from the checkpoint."""
    writer = predict(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_mean(stream: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean of value by key and window; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def update_stream(stream: DataFrame, folder: str, trees: int, checkpoint: str) -> StreamingQuery:
    """Each batch of labelled rows adds trees to the ensemble that is saved in folder (sources.models).  The model's own
    number of batches is written after it, so a batch that comes again after a failure is left out, unless the failure
    fell between these two writes: then its trees are there twice."""
    from ..sources.models import load, save

    def learn(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        model, done = load(spark, folder), f"{folder}/batches"
        seen = spark.read.parquet(done).agg(F.max("number")).first()[0] if _exists(spark, done) else None
        if (seen is None or number > seen) and not batch.isEmpty():
            save(spark, model.update(batch, trees), folder)
            spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("append").parquet(done)

    return stream.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
