"""Fitted tree ensembles as tables: a row a node, and a row of parameters."""

from __future__ import annotations

import json
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trees import Boosting, LambdaRank

KINDS = {c.__name__: c for c in (Boosting, LambdaRank)}


def nodes(spark: SparkSession, model: Boosting | LambdaRank) -> DataFrame:
    """(tree, node, feature, threshold, gain, value, stats); the children of node i are 2i + 1 and 2i + 2, a leaf has no feature."""
    rows = [(t, n, x.get("feature"), x.get("threshold"), x.get("gain"), x.get("value"), x.get("stats") or {}) for t, tree in enumerate(model.trees) for n, x in tree.items()]
    rows = [(t, n, None if f is None else model.features[f], *(None if v is None else float(v) for v in rest), {k: float(v) for k, v in stats.items()}) for t, n, f, *rest, stats in rows]
    return spark.createDataFrame(rows, "tree int, node long, feature string, threshold double, gain double, value double, stats map<string,double>")


def save(spark: SparkSession, model: Boosting | LambdaRank, folder: str) -> None:
    """Writes folder/nodes, and folder/parameters last, so that a folder with parameters is whole."""
    told = {k: v for k, v in asdict(model).items() if k != "trees"}
    nodes(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{folder}/nodes")
    spark.createDataFrame([(type(model).__name__, json.dumps(told))], "kind string, parameters string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/parameters")


def load(spark: SparkSession, folder: str) -> Boosting | LambdaRank:
    kind, told = spark.read.parquet(f"{folder}/parameters").first()
    known = {f.name for f in fields(KINDS[kind])}
    model = KINDS[kind](**{k: v for k, v in json.loads(told).items() if k in known})
    for r in spark.read.parquet(f"{folder}/nodes").orderBy("tree", "node").collect():
        while len(model.trees) <= r["tree"]:
            model.trees.append({})
        own = {"feature": r["feature"] and model.features.index(r["feature"]), "threshold": r["threshold"], "gain": r["gain"], "value": r["value"], "stats": r["stats"]}
        model.trees[r["tree"]][r["node"]] = {k: v for k, v in own.items() if v is not None}
    return model
