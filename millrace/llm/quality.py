"""Quality classifier: a byte-level convolutional network over the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_cnn import ByteCnn
from .common import string_buffer, table, text_chunks

#: Labelled texts that the network is fitted on, at most: those least by a hash of the id.
FIT_ROWS = 2000
#: Steps of the fit at least, so that a small labelled table trains the network as long as a large one.
STEPS = 378
#: Every row whose crc32 (id as text) is a multiple of this is held out.
FOLDS = 5
#: Scores from here on predict 1.
THRESHOLD = 0.3


def held_out(key: str = "doc_id"):
    """Whether the row is never learned from; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> ByteCnn:
    """The network, from at most `rows` labelled documents that are not held out.

    Rows with a null label or id are no examples, of several labels for an id the least counts, a null
    text is empty.  Without examples every text scores one half.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.min(label).alias("label_"))
    chosen = usable.orderBy(F.xxhash64(key), key).limit(rows)
    own = docs.select(key, F.coalesce(text, F.lit("")).alias("text_")).join(F.broadcast(chosen), key).groupBy(key).agg(F.min("text_").alias("text_"), F.min("label_").alias("label_"))
    found = own.orderBy(key).toPandas()
    net = ByteCnn.new()
    if len(found):
        net.fit([t.encode() for t in found["text_"]], found["label_"].to_numpy(), steps=STEPS)
    else:
        net.out[:] = 0
    return net


def score(docs: DataFrame, net: ByteCnn, text: str = "text") -> DataFrame:
    """docs with score, the probability of label 1 from the bytes of the whole text alone.

    A null text scores as an empty one.  A column named score is replaced, all others stay.
    """
    docs = docs.drop("score")
    columns, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text, 1 << 20):
            data, ends, starts = string_buffer(batch.column(text))
            yield pa.record_batch([*batch.columns, pa.array(shared.value.probability(data, starts, ends), pa.float64())], names=[*columns, "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{ddl}, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLE: dict[str, str] = {}
