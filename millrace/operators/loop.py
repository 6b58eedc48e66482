"""Cutting the lineage of driver loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where the session names none, a temporary one in local mode (tests), on a
    cluster an error, as executors don't see each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-shared-")
        _own[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loop/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path_ = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.path_)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def dealt(df: DataFrame) -> DataFrame:
    """Rows that many jobs will read, dealt evenly where their scan has fewer tasks than the cluster has cores; larger tables
    stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    # By row numbers: without a column, the rows of each task would be sorted first.
    return df.repartition(cores, F.monotonically_increasing_id()) if df.rdd.getNumPartitions() < cores else df
