"""Links inside buckets of candidates, and connected components of links, in Spark joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import cut, parts

#: Members, and characters of their texts, that a side of a tile has about at most.
TILE, TILE_CHARS = 512, 1 << 22
#: Rows of buckets of one tile that meet in a group.
SMALL = 4096
#: Rows of a few numbers, as links and members are, that a task has about at most.
NARROW = 1 << 17


def fitted(table: DataFrame, rows: int) -> DataFrame:
    """A narrow table of about so many rows in as few partitions as they ask for.

    The number of partitions grows with the rows. Steps on a table that one task can hold need no exchange, whatever
    number of shuffle partitions the session has.
    """
    return table.coalesce(max(1, -(-rows // NARROW)))


class Forest:
    """Links that connect what all links given connect."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[x] = y
            self.links.append((a, b))


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column of its component for each row and column of a matrix of links; rows without links are undefined."""
    columns = np.arange(linked.shape[1])
    while True:
        row = np.where(linked, columns[None], linked.shape[1]).min(1, initial=linked.shape[1])
        least = np.where(linked, row[:, None], linked.shape[1]).min(0, initial=linked.shape[1])
        least = np.minimum(least, columns)
        if (least == columns).all():
            return row, columns
        columns = least


#: Buckets, nodes and texts.
Side = tuple[np.ndarray, np.ndarray, list[str]]


@dataclass(frozen=True)
class Tiles:
    """How members that no leader settles are compared inside tasks.

    `texts` has (`node`, `text`). `compare` takes two sides and gives links that connect
    what the links between rows of one bucket connect.
    """

    texts: DataFrame
    compare: Callable[[Side, Side], list[tuple[int, int]]]

    def links(self, rest: DataFrame, members: DataFrame) -> DataFrame:
        """Links (`a`, `b`) of `rest` (`bucket`, `node`) with all `members` of their buckets.

        A bucket is cut into tiles, some of its rest against some of its members; buckets of one tile share groups. Only
        links that connect leave a task, so the rows that are made grow with the bucket, not with its square.
        """
        total = members.count()
        keys = ["bucket", "node"]
        met = members.join(rest.select("bucket").distinct().hint("merge"), "bucket", "left_semi")
        both = rest.select(*keys, F.lit(True).alias("left")).unionByName(met.select(*keys, F.lit(False).alias("left")))
        both = fitted(both, total).groupBy(*keys).agg(F.max("left").alias("rest"))
        chars = self.texts.select("node", F.length("text").cast("long").alias("chars"))
        both = cut(fitted(both.join(chars, "node"), total))

        def pieces(of: Column, name: str) -> list[Column]:
            number = F.greatest(F.ceil(F.count(F.when(of, 1)) / TILE), F.ceil(F.sum(F.when(of, F.col("chars"))) / TILE_CHARS))
            return [number.cast("int").alias(name), F.count(F.when(of, 1)).alias(f"{name}_all")]

        both = fitted(both, total)
        sizes = both.groupBy("bucket").agg(*pieces(F.col("rest"), "rows"), *pieces(F.lit(True), "columns"))
        sizes = fitted(cut(fitted(sizes, total)), total)
        small = (F.col("rows") == 1) & (F.col("columns") == 1)
        few = sizes.agg(F.sum(F.when(small, F.col("rows_all") + F.col("columns_all")))).first()[0] or 0
        groups = max(parts(rest.sparkSession), -(-few // SMALL))
        group = F.when(small, F.pmod(F.xxhash64("bucket"), F.lit(groups))).otherwise(F.col("bucket")).alias("group")
        sides = both.where("rest").select(*keys, F.lit(True).alias("left")).unionByName(both.select(*keys, F.lit(False).alias("left")))
        # a text travels by its node before a side is dealt to all tiles of the other
        sides = fitted(sides, 2 * total).join(sizes.hint("merge"), "bucket").join(self.texts.select("node", "text"), "node")
        deal = lambda name, salt: F.when(small, -1).otherwise(F.pmod(F.xxhash64("node", F.lit(salt)), F.col(name)).cast("int"))
        others = F.when(F.col("left"), F.col("columns")).otherwise(F.col("rows"))
        every = F.explode(F.when(small, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), others - 1)))
        own = F.when(F.col("left"), deal("rows", 1)).otherwise(deal("columns", 2))
        sides = sides.select(group, own.alias("own"), every.alias("other"), "left", "bucket", "node", "text")
        i, j = F.when(F.col("left"), F.col("own")).otherwise(F.col("other")), F.when(F.col("left"), F.col("other")).otherwise(F.col("own"))
        sides = sides.select("group", i.alias("i"), j.alias("j"), "left", "bucket", "node", "text")
        compare = self.compare

        def meet(table: pa.Table) -> pa.Table:
            is_left = np.asarray(table["left"])
            sides = [table.filter(pa.array(x)) for x in (is_left, ~is_left)]
            found = compare(*[(np.asarray(x["bucket"]), np.asarray(x["node"]), x["text"].to_pylist()) for x in sides])
            return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

        return sides.groupBy("group", "i", "j").applyInArrow(meet, "a long, b long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (`node`, `label`) for every node of a link; the label is the smallest node of its component.

    Each round replaces the links by links to smaller nodes, in two steps: every node's larger
    neighbours are linked to its smallest neighbour, then its smaller ones. The links become stars;
    the number of rounds grows with the logarithm of the longest path. Links stay in tables.
    """
    def mark(table: DataFrame) -> tuple:
        """Number of links and two fingerprints of their set."""
        return tuple(table.agg(F.count(F.lit(1)), *[F.bit_xor(F.xxhash64("u", "v", F.lit(k))) for k in (1, 2)]).first())

    edges = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    before = mark(edges)
    while before[0]:
        rows = before[0]
        edges = fitted(edges, rows)
        both = fitted(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * rows)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = fitted(large.where("u <> v").distinct(), rows)
        # every link now goes from a node to a smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(fitted(low.select("u", F.col("m").alias("v")).unionByName(small), rows).distinct())
        now = mark(edges)
        if now == before:
            break
        before = now
    edges = fitted(edges, before[0])
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    ends = stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")))
    return fitted(ends, 2 * before[0]).distinct()


def linked(
    members: DataFrame, measure: Callable[[DataFrame], DataFrame], limit: float, possible: str | Tiles, rounds: int = 2
) -> DataFrame:
    """Links (`a`, `b`) that connect all members of a bucket that are connected within it.

    `members` has rows (`bucket`, `node`, `order`) and further columns; `measure` adds the `distance` to
    pairs of nodes. A bucket is not expanded into pairs: its members are compared with a leader, the
    one with the smallest `order`, and those within the limit are connected through it. The others
    are compared with a second leader out of the connected ones, and so on. Only what is left after the
    last round is compared with all members of its bucket: in tiles, or as rows for which `possible` holds, an SQL
    condition on the rows `x` and `y` that no link can fail. It may use `led`, a row's distance to the bucket's first
    leader, and `lead`, that leader's row.
    """
    found = []
    total = members.count()
    members = fitted(members, total)
    rest = members
    connected = members
    used = places = None
    tiled = isinstance(possible, Tiles)
    rest_of = [c for c in members.columns if c not in ("bucket", "node", "order")]
    left_over = True
    for _ in range(rounds):
        heads = connected.groupBy("bucket").agg(F.min(F.struct("order", "node", *rest_of)).alias("lead"))
        heads = heads.select("bucket", F.col("lead.node").alias("b"), *([] if tiled else ["lead"]))
        heads = fitted(cut(fitted(heads, total)), total)
        placed = fitted(cut(fitted(rest.join(heads.hint("merge"), "bucket", "left"), total)), total)
        pairs = placed.where("node <> b")
        measured = fitted(cut(measure(fitted(pairs.select(F.col("node").alias("a"), "b").distinct(), total))), total)
        found.append(measured.where(F.col("distance") <= limit).select("a", "b"))
        judged = pairs.withColumnRenamed("node", "a").join(measured.hint("merge"), ["a", "b"]).withColumnRenamed("a", "node")
        judged = fitted(cut(fitted(judged, total)), total)
        near = judged.where(F.col("distance") <= limit).select(*members.columns)
        # a bucket may have no leader any more
        rest = judged.where(F.col("distance") > limit).select(*members.columns)
        rest = fitted(rest.unionByName(placed.where("b is null").select(*members.columns)), total)
        if places is None and not tiled:
            own = heads.select("bucket", F.col("b").alias("node"), F.lit(0.0).alias("led"), "lead")
            places = judged.select("bucket", "node", F.col("distance").alias("led"), "lead").unionByName(own)
        heads = heads.select("bucket", F.col("b").alias("node"))
        used = heads if used is None else fitted(used.unionByName(heads), total)
        # the next leader is connected, and new
        connected = near if connected is members else fitted(connected.unionByName(near), total)
        connected = connected.join(used.hint("merge"), ["bucket", "node"], "left_anti")
        left_over = not rest.isEmpty()
        if not left_over:
            break
    if tiled and left_over:
        found.append(possible.links(rest, members))
    elif not tiled:
        members = cut(members.join(places, ["bucket", "node"]))
        x, y = members.join(rest.select("bucket", "node"), ["bucket", "node"], "left_semi").alias("x"), members.alias("y")
        pairs = x.join(y, F.expr(f"x.bucket = y.bucket and x.node <> y.node and ({possible})"))
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        found.append(measure(pairs).where(F.col("distance") <= limit).select("a", "b"))
    links = found[0]
    for part in found[1:]:
        links = links.unionByName(part)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
