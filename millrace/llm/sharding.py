"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, table

#: The ring has 2 ** 32 places.
RING_BITS = 32
SHARDS = 40
#: Virtual nodes of a shard.
VNODES = 128


def ring(n_shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node in ring order: the first 8 hex digits of md5('shard:copy')."""
    if n_shards < 1 or vnodes < 1:
        raise ValueError("at least one shard and one virtual node are needed")
    return sorted((int(hashlib.md5(f"{s}:{v}".encode()).hexdigest()[:8], 16), s) for s in range(n_shards) for v in range(vnodes))


def allot(arc_counts: dict[int, int], places: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Who takes which keys: (arc, shard, first rank, end rank, first slot).

    Pass 0 offers the keys of every arc to the shard of the virtual node that ends it; what a full
    shard can't take moves on to the next virtual node in pass 1, and so on clockwise.  Within a pass
    virtual nodes act in ring order, and an arc gives up its keys in the order of their rank.  Works on
    counts alone: as many numbers as there are virtual nodes, however many keys there are.
    """
    free, n = list(capacity), len(places)
    taken, slots, out = dict.fromkeys(arc_counts, 0), [0] * len(capacity), []
    waiting = [(a, c) for a, c in sorted(arc_counts.items()) if c]
    for step in range(n):
        rest = []
        for arc, left in waiting:
            shard = places[(arc + step) % n][1]
            if take := min(left, free[shard]):
                out.append((arc, shard, taken[arc], taken[arc] + take, slots[shard]))
                taken[arc] += take
                slots[shard] += take
                free[shard] -= take
            if left > take:
                rest.append((arc, left - take))
        waiting = rest
        if not waiting:
            break
    return out


def shard(docs: DataFrame, n_shards: int = SHARDS, key: str = "doc_id", vnodes: int = VNODES) -> DataFrame:
    """docs with shard (0 to n_shards - 1) and slot (0, 1, ... within its shard).

    A key's place on the ring is the first 8 hex digits of md5(key as text); a null key counts as
    the text 'null'.  Capacities add up to the number of rows and differ by one at most, so that
    after the overflow of full shards has gone clockwise every shard is full: row counts are at
    most one apart.  Rows of one arc are ranked by place, key and a hash of the row; ties are equal
    rows, of which any order gives the same result.  An empty table gives an empty result; extra
    columns stay, whatever their names (columns named shard or slot are replaced).  Each arc is ranked in a
    window of its own, of which there are n_shards * vnodes; the driver sees a count for each arc.
    """
    docs = docs.drop("shard", "slot")
    place_, cell_, before_, ends_, arc_, parts_, rank_, part_ = free(docs.columns, "place", "cell", "before", "ends", "arc", "parts", "rank", "part")
    spark, places = docs.sparkSession, ring(n_shards, vnodes)
    ends = [p for p, _ in places]
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    place = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    # The arc of a place is the number of virtual nodes before it: a broadcast table of (high bits of
    # the place -> virtual nodes there) keeps this a short array search.
    shift = RING_BITS - 10
    cells: dict[int, list[int]] = {c: [] for c in range(1 << 10)}
    for p in ends:
        cells[p >> shift].append(p)
    before, rows = 0, []
    for c in range(1 << 10):
        rows.append((c, before, cells[c]))
        before += len(cells[c])
    lookup = spark.createDataFrame(rows, f"{cell_} int, {before_} int, {ends_} array<long>")
    placed = docs.withColumn(place_, place).withColumn(cell_, F.shiftright(place_, shift).cast("int")).join(F.broadcast(lookup), cell_)
    arc = (F.col(before_) + F.size(F.filter(ends_, lambda e: e < F.col(place_)))) % len(places)
    placed = placed.withColumn(arc_, arc.cast("int")).drop(cell_, before_, ends_)
    counts = {r[0]: r[1] for r in placed.groupBy(arc_).agg(F.count("*")).collect()}
    total = sum(counts.values())
    capacity = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    parts = allot(counts, places, capacity)
    quota = spark.createDataFrame([(a, [(s, lo, hi, at) for b, s, lo, hi, at in own]) for a, own in _by_arc(parts)], f"{arc_} int, {parts_} array<struct<shard:int,lo:long,hi:long,at:long>>")
    order = Window.partitionBy(arc_).orderBy(place_, F.col(f"`{key}`"), *[F.xxhash64(F.col(f"`{c}`")) for c in docs.columns if c != key])
    ranked = placed.withColumn(rank_, F.row_number().over(order).cast("long") - 1).join(F.broadcast(quota), arc_)
    part = F.filter(parts_, lambda p: (p["lo"] <= F.col(rank_)) & (F.col(rank_) < p["hi"]))[0]
    return ranked.withColumn(part_, part).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{part_}.shard").alias("shard"), (F.col(f"{part_}.at") + F.col(rank_) - F.col(f"{part_}.lo")).alias("slot"))


def _by_arc(parts):
    own: dict[int, list] = {}
    for p in parts:
        own.setdefault(p[0], []).append(p)
    return sorted(own.items())


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    thin = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(thin).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLE: dict[str, str] = {}
