"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard_join, packing, quality, secret_scan
from millrace.llm.common import shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the classifier's threshold or above.

    A null or empty text scores as no bytes do, a null doc_id is never learned from; repeated rows score alike, so all
    stay or all go; an empty table stays empty; columns beyond those of documents are dropped.
    """
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), net).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8: the general contract of pipelines) the least doc_id.

    Null, empty and blank texts are copies of nothing and stay, as do rows without doc_id; of rows with one doc_id, one
    stays (the least by hashes of its columns); an empty table stays empty; extra columns are dropped.
    """
    return jaccard_join.deduplicate(docs.select(*COLUMNS), percent=80, words=5)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows don't contaminate.

    A null or empty text has no words and stays; repeated rows are judged alike; with an empty benchmark all stay; an
    empty table stays empty; extra columns are dropped.
    """
    found = decontaminate.scan(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows the text (null for a null text).

    Every row stays, null and empty texts as they are; repeated rows are masked alike; with no text to learn plain words
    from the network learns from its findings alone; extra columns are dropped.
    """
    scanner = secret_scan.fit(documents=secret_scan.sample(docs))
    found = secret_scan.redact(secret_scan.scan(docs.select(*COLUMNS), scanner))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with the token ids.

    A null or empty text is the end id alone; repeated and null keys keep their own pieces; an empty table gives none;
    extra columns are dropped.
    """
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]

#: The network's decisions can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
