"""Merkle manifest of a dataset: a tree over each group's rows and one over the groups.

A leaf is a digest over a row's fields. Rows of a group, in order, are the bottom of its tree; every `arity`
consecutive nodes become the digest of their concatenation. The groups' roots, in order, are the bottom of
the top tree. Only every few levels are kept (checkpoints): `every` levels of a subtree are aligned blocks of
arity^every nodes, and a stored row is the array of a block's nodes. A proof is put together from the top
down: each block's missing interior nodes are computed again from its stored nodes, their siblings are
given to each node of the block and the interior nodes are forgotten. A block's row is bounded, whatever
the size of its group, and each level stored has a block's fraction of the rows of the level below.

Places of rows come from a sort into ranges and the counts of each range, not from one window.

Defined cases: fields that are null count as `-`; null groups and null keys come first; rows that agree in
group and key are ordered by their digest, copies of a row by where they were read. A group of one row has its leaf as
root; a single group's root is the root of all. An empty table has no trees and no proofs. Very long texts are hashed whole
where they are read and do not travel. Columns that are not named take no part, so that no name can clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail.llm.common import cut, scratch

ARITY, EVERY = 3, 4
#: The tree of the groups' roots; group keys begin with another character.
TOP = "."


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*fields: str | Column) -> Column:
    """Digest over fields: `-` for null, else the number of UTF-8 bytes, `:` and the value."""

    def coded(field: str | Column) -> Column:
        value = (F.col(field) if isinstance(field, str) else field).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*[coded(x) for x in fields]))


@dataclass(frozen=True)
class Manifest:
    """`blocks[j]` has the stored blocks of level `j * every`; `tops` the groups' roots, with their root."""

    blocks: list[DataFrame]
    tops: DataFrame
    arity: int
    every: int


def _placed(rows: DataFrame, order: Sequence[str], arity: int) -> DataFrame:
    """`rows` with the `height` of their `tree` and their `place` in it, by `order`."""
    rows = cut(rows.withColumn("_tie", F.monotonically_increasing_id()))
    keys = ["tree", *order, "_tie"]
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # ids count up within a partition, so they are places in its range
    ranges = ranges.withColumns({"_range": F.spark_partition_id(), "_line": F.monotonically_increasing_id()}).drop("_tie")
    ranges = cut(ranges)
    counts = ranges.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_line").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.sum("_rows").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("tree", "_range", "_first", F.coalesce(before, F.lit(0)).alias("_start"), _height(F.sum("_rows").over(tree), arity).alias("height"))
    placed = ranges.join(counts, ["tree", "_range"]).withColumn("place", F.col("_line") - F.col("_first") + F.col("_start"))
    return placed.drop("_range", "_line", "_first", "_start")


def _height(size: Column, arity: int) -> Column:
    """Levels above `size` nodes until one is left."""
    powers = [arity**k for k in range(64) if arity**k < 2**62]
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in powers]), lambda p: p < size))


def _above(low: Column, arity: int) -> Column:
    """The level above the nodes `low`."""
    runs = F.sequence(F.lit(0), F.floor((F.size(low) - 1) / arity).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(low, i * arity + 1, F.lit(arity)), "")))


def _regrown(blocks: DataFrame, stage: int, arity: int, every: int) -> DataFrame:
    """Blocks, of which only the topmost may end below `every` levels, with `_up0`, `_up1`, ..., the nodes of their levels."""
    blocks = blocks.withColumn("_levels", F.least(F.col("height") - stage * every, F.lit(every)))
    blocks = blocks.withColumn("_up0", F.transform("nodes", lambda x: x["node"]))
    for k in range(1, every + 1):
        # a column for each level, so that no level is computed twice
        blocks = blocks.withColumn(f"_up{k}", F.when(F.col("_levels") >= k, _above(F.col(f"_up{k - 1}"), arity)).otherwise(F.col(f"_up{k - 1}")))
    return blocks


def _blocks(nodes: DataFrame, carried: Sequence[str], arity: int, every: int) -> DataFrame:
    """Aligned blocks of nodes, as one row each."""
    per = arity**every
    grouped = nodes.groupBy("tree", "height", F.expr(f"place div {per}").alias("block"))
    return grouped.agg(F.sort_array(F.collect_list(F.struct("place", "node", *carried))).alias("nodes"))


def _grown(nodes: DataFrame, carried: Sequence[str], folder: str, arity: int, every: int) -> tuple[list[DataFrame], DataFrame]:
    """Stored blocks of every `every`-th level, and the root of each tree."""
    spark, stored, roots = nodes.sparkSession, [], None
    while True:
        stage = len(stored)
        path = f"{folder}/level={stage * every}"
        _blocks(nodes, carried if stage == 0 else [], arity, every).write.parquet(path)
        stored.append(spark.read.parquet(path))
        above = _regrown(stored[-1], stage, arity, every)
        above = above.select("tree", "height", F.col("block").alias("place"), F.col(f"_up{every}")[0].alias("node"))
        ended = F.col("height") <= (stage + 1) * every
        done = above.where(ended).select("tree", "height", F.col("node").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        nodes = above.where(~ended)
        if not stored[-1].where(~ended).limit(1).count():
            return stored, roots


def build(
    rows: DataFrame, group: str, order: Sequence[str], node: str = "leaf", carried: Sequence[str] = (),
    folder: str | None = None, arity: int = ARITY, every: int = EVERY,
) -> Manifest:
    """Trees over `rows`, whose digest is `node`; `order` and `carried` columns stay with the leaves.

    The stored levels are tables below `folder`, a new one in the shared folder if none is given.
    """
    if arity < 2 or every < 1:
        raise ValueError("arity is at least 2, and at least every level is kept")
    folder = folder or scratch(rows.sparkSession, "manifest")
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree")
    kept = list(dict.fromkeys([*order, *carried]))
    leaves = _placed(rows.select(tree, F.col(node).alias("node"), *[F.col(c).alias(f"c_{c}") for c in kept]), [*[f"c_{c}" for c in order], "node"], arity)
    blocks, roots = _grown(leaves, [f"c_{c}" for c in kept], f"{folder}/rows", arity, every)
    # "-" stands before "=", so null groups come first
    tops = roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("c_tree"), F.col("root").alias("node"))
    top, root = _grown(_placed(tops, ["c_tree"], arity), ["c_tree"], f"{folder}/groups", arity, every)
    found = _paths(top, root.select("tree", F.col("root").alias("root"), F.array().cast(PATH).alias("path")), ["root"], arity, every)
    found = found.select(F.col("c_tree").alias("tree"), F.col("node").alias("subroot"), "root", "path")
    found.write.parquet(f"{folder}/tops")
    return Manifest(blocks, rows.sparkSession.read.parquet(f"{folder}/tops"), arity, every)


PATH = "array<struct<left:string,right:string>>"


def _paths(stored: Sequence[DataFrame], tops: DataFrame, also: Sequence[str], arity: int, every: int) -> DataFrame:
    """The nodes of the lowest level with their siblings on the way up (`path`), from the top down.

    `tops` has a row for each tree with the siblings of its root and the columns `also`.
    """
    above = None
    for stage in reversed(range(len(stored))):
        blocks = _regrown(stored[stage], stage, arity, every)
        ended = F.col("height") <= (stage + 1) * every
        path = blocks.where(ended).join(tops, "tree")
        if above is not None:
            above = above.select("tree", F.col("place").alias("block"), *also, "path")
            lower = blocks.where(~ended).join(above, ["tree", "block"])
            path = path.unionByName(lower)

        def beside(i: Column) -> Column:
            """Siblings of node i of a block, level by level: those to the left, those to the right."""
            found = []
            for k in range(every):
                at = F.floor(i / arity**k).cast("int")
                first = at - at % arity
                ups = F.col(f"_up{k}")
                left = F.array_join(F.slice(ups, first + 1, at - first), "")
                right = F.array_join(F.slice(ups, at + 2, first + arity - at - 1), "")
                found.append(F.when(F.col("_levels") > k, F.struct(left.alias("left"), right.alias("right"))))
            return F.filter(F.array(*found), lambda x: x.isNotNull()).cast(PATH)

        each = F.transform("nodes", lambda x, i: F.struct(x.alias("at"), beside(i).alias("low")))
        path = path.select("tree", *also, "path", F.explode(each).alias("_x"))
        above = path.select("tree", *also, "_x.at.*", F.concat("_x.low", "path").alias("path"))
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """Each leaf's `tree`, `place`, `node`, its columns (`c_...`), `subroot`, `root` and `path`.

    `path` has, from the leaf to the root, the digests of the siblings to the left and to the right, joined.
    """
    return _paths(manifest.blocks, manifest.tops, ["subroot", "root"], manifest.arity, manifest.every)


def siblings(path: Column) -> Column:
    """All siblings of a path, joined."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, node, lambda low, x: digest(F.concat(x["left"], low, x["right"])))


def verified(docs: DataFrame, fields: Sequence[str], group: str, key: str, seen: Column, folder: str | None = None) -> DataFrame:
    """Trees over `docs` and, for each row, the root that its digest as `seen` now gives with the original siblings."""
    rows = docs.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf(*fields).alias("leaf"), seen.alias("seen"))
    found = proofs(build(rows, "group", ["key"], carried=["seen"], folder=folder))
    found = found.select(
        F.col("c_key").alias(key), F.col("node").alias("leaf"), "subroot", "root", "path",
        folded(F.col("c_seen"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
