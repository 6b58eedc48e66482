"""Merkle manifest of a dataset: blocks of leaves swap their roots in a butterfly, so that each gets its proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from .common import removed, table, written

#: Nodes of a run; levels within a block, so that a block holds FANOUT ** LEVELS leaves.
FANOUT, LEVELS = 16, 3
BLOCK = FANOUT**LEVELS
#: Blocks of a group that meet one copy of their group's own proof.
SHARE = 1024

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*values: Column) -> Column:
    """Hex SHA-256 of the values on end, each as '-' if null, else its UTF-8 bytes, ':' and itself as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def butterfly(nodes: DataFrame) -> DataFrame:
    """(g, i, root, up) of nodes (g, i, n, node): the hex digest of node i of the n in group g, i from 0.

    Round r: the nodes of level r that become one are an aligned run of FANOUT; of each, the member with place c in its
    own subtree swaps with those of place c in the others, and all of them hash the parent.  So the parents are hashed
    again by each member, and each member knows its ancestors and their siblings when the rounds end, without a way
    down.  Where the last subtree has fewer members, each of these stands in for places that it lacks.
    up: of each level the node's place in its run, and the run.  Groups with a single node keep it as their root.
    """
    state = written(nodes.select("g", "i", "n", "node", F.expr("cast(array() as array<struct<place:int,run:array<string>>>)").alias("up")))
    most, width = state.agg(F.max("n")).first()[0] or 0, 1
    while most > width:
        # j: the node of this level that stands for member i; it has `held` members, of which i is number c.
        open_ = state.where(F.col("n") > width).selectExpr("*", f"i div {width} as j", f"i % {width} as c", f"least(n - (i div {width}) * {width}, {width}) as held")
        sent = open_.select("g", "n", F.expr(f"j div {FANOUT}").alias("p"), F.explode(F.expr(f"sequence(c, {width - 1}L, held)")).alias("place"), "c", "j", "node", "i", "up")
        own = F.col("place") == F.col("c")
        met = sent.groupBy("g", "n", "p", "place").agg(F.sort_array(F.collect_list(F.struct("j", "node", F.when(own, F.col("i")).alias("i"), F.when(own, F.col("up")).alias("up")))).alias("met"))
        met = met.withColumn("run", F.expr("transform(met, x -> x.node)")).withColumn("node", F.sha2(F.array_join("run", ""), 256))
        met = met.select("g", "n", "node", "run", F.explode(F.expr("filter(met, x -> x.i is not null)")).alias("m"))
        after = met.select("g", "m.i", "n", "node", F.expr(f"concat(m.up, array(struct(cast(m.j % {FANOUT} as int) as place, run as run)))").alias("up"))
        last, state = state, written(after.unionByName(state.where(F.col("n") <= width)))
        removed(last)
        width *= FANOUT
    return state.select("g", "i", F.col("node").alias("root"), "up")


def _levels(leaves: list[str], alone: bool) -> list[list[str]]:
    """The nodes of a block by level: LEVELS of them above the leaves, or until one remains if the group has no other block."""
    out = [leaves]
    while len(out[-1]) > 1 if alone else len(out) <= LEVELS:
        out.append([_hash("".join(out[-1][k : k + FANOUT])) for k in range(0, len(out[-1]), FANOUT)])
    return out


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray, list[str]]]:
    """(row, leaves in order, their digests as hex) of the packed blocks of a batch."""
    lists = batch.column("leaves")
    for row in range(batch.num_rows):
        own = lists[row].values
        yield row, own, [v.hex() for v in own.field("leaf").to_pylist()]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = [_levels(leaves, n == 1)[-1][0] for (_, _, leaves), n in zip(_blocks(batch), batch.column("n").to_pylist())]
        yield pa.record_batch([*(batch.column(c) for c in ("g", "i", "n")), pa.array(nodes, pa.string())], names=["g", "i", "n", "node"])


def _fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        leaf = _hash(before + leaf + after)
    return leaf


def _prove(key: str, group: str):
    """Of every leaf in packed blocks: its digest, the digest of its proof, the root folded from its claim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = zip(*(batch.column(c).to_pylist() for c in ("n", "subroot", "root", "up", "top")))
            for (row, own, leaves), (n, subroot, root, up, top) in zip(_blocks(batch), tops):
                levels = _levels(leaves, n == 1)
                above = [("".join(u["run"][: u["place"]]), "".join(u["run"][u["place"] + 1 :])) for u in (*up, *top)]
                tail = "".join(a + b for a, b in above)
                proofs, folded = [], []
                for k, (leaf, claim) in enumerate(zip(leaves, own.field("claim").to_pylist())):
                    path, at = [], k
                    for level in levels[:-1]:
                        first = at - at % FANOUT
                        path.append(("".join(level[first:at]), "".join(level[at + 1 : first + FANOUT])))
                        at //= FANOUT
                    proofs.append(_hash("".join(a + b for a, b in path) + tail))
                    folded.append(_fold(leaf if claim is None else claim.hex(), path + above))
                same = lambda v: pa.array([v] * len(leaves), pa.string())
                yield pa.record_batch([own.field("key"), batch.column("group").take(pa.array([row] * len(leaves), pa.int64())), pa.array(leaves, pa.string()), same(subroot), same(root), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])], names=[key, group, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, claim: Column | None = None) -> DataFrame:
    """(key, group, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs.

    A row's leaf is the digest() of its columns.  The leaves of a group ascend by key; while several nodes remain, each
    FANOUT of them in a row become one.  The nodes that remain, by group (null first, bytewise), become the root in the
    same way.  claim is the digest that a row is said to have (null: its leaf); folded_root is the root that it and the
    siblings of its leaf give, verified whether that is the root.

    Null values in any column are told from empty ones, and a null group is one of its own; null keys come first, and
    rows of one key ascend by leaf, so repeated rows each have a leaf and order does not depend on the partitions.  An
    empty table gives no rows.  Extra columns, whatever their names, are neither read nor returned.

    Leaves are put in order range by range and dealt into blocks of BLOCK, so a group of any size is spread; its blocks
    meet only in the butterfly().
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = F.lit(None).cast("binary") if claim is None else F.unhex(claim)
    leaves = written(docs.select(F.col(group).alias("group"), F.col(key).alias("key"), F.unhex(digest(*map(F.col, columns))).alias("leaf"), told.alias("claim")))
    order = ["group", "key", "leaf"]
    # A row's number tells its range and its place there.
    placed = written(leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()).selectExpr("*", "shiftright(id, 33) as range_", "id & ((1L << 33) - 1) as at"))
    removed(leaves)
    # Of a group in a range: the first place, the leaves of the group before it; a row a range or a group, so few.
    runs = placed.groupBy("range_", "group").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    w = Window.partitionBy("group")
    runs = written(runs.select("range_", "group", "first", F.coalesce(F.sum("held").over(w.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("held").over(w).alias("total")))
    groups = numbered(runs.select("group", "total").distinct(), ["group"], "g").select(F.col("group").alias("group_"), F.expr("g - 1").alias("g"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("n"))
    groups = written(groups)
    runs = runs.join(groups, F.col("group").eqNullSafe(F.col("group_"))).select(F.col("range_").alias("r_"), "group_", "first", "before", "g", "n")
    at = placed.join(runs, (F.col("range_") == F.col("r_")) & F.col("group").eqNullSafe(F.col("group_"))).withColumn("at", F.expr("before + at - first"))
    packed = at.groupBy("g", F.expr(f"at div {BLOCK}").alias("i"), "n", "group").agg(F.sort_array(F.collect_list(F.struct(F.expr(f"cast(at % {BLOCK} as int)").alias("k"), "key", "leaf", "claim"))).alias("leaves"))
    packed = written(packed)
    removed(placed)
    roots = written(butterfly(packed.select("g", "i", "n", "leaves").mapInArrow(_roots, "g long, i long, n long, node string")))
    subroots = roots.where("i = 0").join(groups.select("g", "n"), "g").select("g", "n", F.col("root").alias("subroot"))
    n_groups = groups.count()
    tops = butterfly(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(n_groups).cast("long").alias("n"), F.col("subroot").alias("node")))
    tops = tops.select(F.col("i").alias("g"), "root", F.col("up").alias("top")).join(groups.select("g", "n"), "g")
    # The blocks of a large group meet several copies of its row.
    tops = tops.select("g", "root", "top", F.explode(F.expr(f"sequence(0L, (n - 1) div {SHARE})")).alias("share"))
    up = roots.select("g", "i", F.col("root").alias("subroot"), "up", F.expr(f"i div {SHARE}").alias("share")).join(tops, ["g", "share"]).drop("share")
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    return packed.join(up, ["g", "i"]).mapInArrow(_prove(key, group), f"`{key}` {kind[key]}, `{group}` {kind[group]}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claim = F.when(tampered, digest(*(lower if c == "text" else F.col(c) for c in COLUMNS)))
    return manifest(docs, claim=claim).drop("source")


def _oracle(leaf_levels: int = 8, group_levels: int = 5) -> str:
    """The tree as SQL, level by level: up to 16^8 leaves a source and 16^5 sources."""
    part = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in COLUMNS) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "xor(c >> 1, (c & 1) * 3988292384)"
    sql = ["bits0 as (select i, cast(i as bigint) as c from range(256) as r(i))"]
    sql += [f"bits{k + 1} as (select i, {step} as c from bits{k})" for k in range(8)]
    sql += ["crc as (select list(c order by i) as tab from bits8)"]
    crc = "xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
    sql += [f"d as (select doc_id, source, {leaf('text')} as leaf, case when {crc} % 5 = 0 then {leaf(low)} else {leaf('text')} end as claim from documents, crc)"]
    sql += ["l as (select doc_id, leaf, claim, dense_rank() over (order by source nulls first) - 1 as g, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from d)"]
    around = "coalesce(string_agg(h, '') over (partition by g, i // 16 order by i rows between unbounded preceding and 1 preceding), '') as pre, coalesce(string_agg(h, '') over (partition by g, i // 16 order by i rows between 1 following and unbounded following), '') as post"

    def tree(name: str, levels: int) -> None:
        for k in range(levels):
            sql.append(f"{name}s{k} as (select *, {around} from (select *, count(*) over (partition by g) as n from {name}{k}))")
            sql.append(f"{name}{k + 1} as (select g, i // 16 as i, case when max(n) > 1 then sha256(string_agg(h, '' order by i)) else max(h) end as h from {name}s{k} group by g, i // 16)")

    sql.append("a0 as (select g, i, leaf as h from l)")
    tree("a", leaf_levels)
    sql.append(f"b0 as (select 0 as g, g as i, h from a{leaf_levels})")
    tree("b", group_levels)
    sql.append("f0 as (select doc_id, leaf, claim as f, g, i, '' as proof from l)")
    for k in range(leaf_levels):
        sql.append(f"f{k + 1} as (select doc_id, leaf, case when n > 1 then sha256(pre || f || post) else f end as f, f{k}.g, f{k}.i, proof || pre || post as proof from f{k} join as{k} as s on s.g = f{k}.g and s.i = f{k}.i // {16**k})")
    for k in range(leaf_levels, leaf_levels + group_levels):
        sql.append(f"f{k + 1} as (select doc_id, leaf, case when n > 1 then sha256(pre || f || post) else f end as f, f{k}.g, f{k}.i, proof || pre || post as proof from f{k} join bs{k - leaf_levels} as s on s.i = f{k}.g // {16 ** (k - leaf_levels)})")
    last = leaf_levels + group_levels
    return "with " + ",\n".join(sql) + f"\nselect doc_id, leaf, a{leaf_levels}.h as subroot, b{group_levels}.h as root, sha256(proof) as proof_sha256, f as folded_root, f = b{group_levels}.h as verified from f{last} join a{leaf_levels} on a{leaf_levels}.g = f{last}.g, b{group_levels}"


QUERIES = {"op11_merkle": op11_merkle}
ORACLE = {"op11_merkle": _oracle()}
