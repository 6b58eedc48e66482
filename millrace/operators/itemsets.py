"""Frequent itemsets and association rules, level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loop import written


@dataclass
class Apriori:
    """baskets: (tid, item) rows.  Itemsets are sorted arrays; all splits of an itemset are candidate rules."""

    min_support: float = 0.5
    min_confidence: float = 0.7
    max_size: int | None = None
    itemsets: DataFrame | None = None
    rules: DataFrame | None = None

    def fit(self, baskets: DataFrame) -> Apriori:
        pairs = written(baskets.select("tid", "item").where("item is not null").distinct())
        n = baskets.select("tid").distinct().count()
        support = lambda c: (c / n).alias("support")
        level = written(pairs.groupBy("item").agg(F.count("*").alias("c")).where(F.col("c") >= self.min_support * n - 1e-9).select(F.array("item").alias("items"), support(F.col("c"))))
        held = written(pairs.join(level.select(level["items"][0].alias("item")), "item").select("tid", F.array("item").alias("items")))
        single, found, size = held, level, 1
        while (self.max_size is None or size < self.max_size) and level.limit(1).count():
            # A basket's k-set and its later item make its (k+1)-sets; those with an infrequent k-subset can't be frequent, and are not counted.
            grown = held.join(single.select("tid", F.col("items")[0].alias("item")), "tid").where(F.col("item") > F.element_at("items", -1)).select("tid", F.concat("items", F.array("item")).alias("items"))
            counted = grown.groupBy("items").agg(F.count("*").alias("c")).where(F.col("c") >= self.min_support * n - 1e-9)
            level = written(counted.select("items", support(F.col("c"))))
            held = written(grown.join(level.select("items"), "items", "left_semi").select("tid", "items"))
            found, size = found.unionByName(level), size + 1
        self.itemsets = written(found)
        return self

    def get_frequent_itemsets(self, min_size: int = 1) -> DataFrame:
        return self.itemsets.where(F.size("items") >= min_size).orderBy(F.desc("support"), "items")

    def generate_rules(self) -> DataFrame:
        sets = self.itemsets.where("size(items) >= 2")
        masks = sets.select("items", "support", F.explode(F.expr("sequence(1, cast(pow(2, size(items)) as int) - 2)")).alias("m"))
        side = lambda bit: F.expr(f"filter(items, (x, i) -> (shiftright(m, i) & 1) = {bit})")
        split = masks.select(side(1).alias("antecedent"), side(0).alias("consequent"), "support")
        a = self.itemsets.select(F.col("items").alias("antecedent"), F.col("support").alias("sa"))
        c = self.itemsets.select(F.col("items").alias("consequent"), F.col("support").alias("sc"))
        rules = split.join(a, "antecedent").join(c, "consequent").select("antecedent", "consequent", "support", (F.col("support") / F.col("sa")).alias("confidence"), (F.col("support") / (F.col("sa") * F.col("sc"))).alias("lift"))
        self.rules = written(rules.where(F.col("confidence") >= self.min_confidence - 1e-9))
        return self.rules

    def get_rules(self, min_confidence: float = 0.0, min_lift: float = 0.0) -> DataFrame:
        return self.rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)).orderBy(F.desc("confidence"), "antecedent", "consequent")

    def predict(self, baskets: DataFrame) -> DataFrame:
        """(tid, item, confidence): new items that rules with antecedents in the basket give, with their best confidence."""
        items = baskets.select("tid", "item").distinct()
        parts = self.rules.withColumn("rule", F.xxhash64("antecedent", "consequent")).select("rule", "antecedent", "consequent", "confidence", F.explode("antecedent").alias("item"))
        met = items.join(parts, "item").groupBy("tid", "rule").agg(F.count("*").alias("n"), F.first("antecedent").alias("a"), F.first("consequent").alias("c"), F.first("confidence").alias("confidence")).where("n = size(a)")
        new = met.select("tid", F.explode("c").alias("item"), "confidence").groupBy("tid", "item").agg(F.max("confidence").alias("confidence"))
        return new.join(items, ["tid", "item"], "left_anti")
