"""Near-duplicate vectors by product quantisation, with an exact cosine for every candidate.

Vectors are dealt to coarse inverted lists; a list keeps each member's residual as one code for each subspace.
A vector asks its own list and all lists whose boundary it is near: a partner at the limit lies
`LIMIT` away in an unknown direction, so that its step across a boundary is about LIMIT / sqrt(dimensions), and
`MARGIN` times that is allowed for. Asymmetric distances (exact query, coded member) are sums of looked-up
terms; a member is a candidate if its distance is within the limit plus its own coding error, which the triangle
inequality makes loss-free. Candidates are decided by the cosine of the original vectors in double precision.

Equal vectors are one node with a count. Lists are cut into groups of bounded members and bounded queries, so a list with
a third of all rows is many tasks. A group returns the number of links of each query and links that connect
what its links connect (a spanning forest), never its pairs, so that a group of thousands of near copies gives
thousands of rows. Classes are the connected components of these links.

Lists are centroids of a bounded sample (`SAMPLE` distinct vectors by hash); there is one for `LIST` distinct vectors, but
at most `LISTS`. All vectors are indexed and all of them are queries. The codebooks have a fixed size.

Defined cases: a vector that is null, zero or holds null or non-finite components links with nothing; shorter
vectors count as filled up with zeros; rows with equal vectors are linked, whatever their ids; rows that share an id are
one node and share its links and class; a row without an id has no links and no class and is kept. Other columns take
no part, so that no name can clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import cut
from labtrail.llm.components import Forest, components, spanning

COSINE = 0.95
SAMPLE = 16_384
LIST, LISTS = 512, 4096
PARTS, CODES = 8, 256
MARGIN = 3.2
#: Members and queries of a group.
MEMBERS, QUERIES = 1024, 2048
#: Added to distances, for sums in single precision.
SLACK = 1e-3


@dataclass(frozen=True)
class Index:
    """Centroids of lists, (lists, width); of each subspace's codes, (codes, its width); the subspaces' limits."""

    lists: np.ndarray
    books: list[np.ndarray]
    limits: np.ndarray


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as doubles, filled up with zeros, and which of them have a direction."""
    out = np.zeros((len(column), width))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(width)[None] < sizes[:, None]] = values
    top = np.abs(out).max(axis=1, initial=0)
    return out, np.isfinite(top) & (top > 0)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def squares(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.maximum((rows * rows).sum(1)[:, None] - 2 * rows @ points.T + (points * points).sum(1), 0)


def nearest(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(rows[k : k + 4096], points).argmin(1) for k in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, int)


def means(rows: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows; a centre without rows stays."""
    centres = rows[np.linspace(0, len(rows) - 1, min(count, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(rows, centres)
        sums = np.zeros(centres.shape)
        np.add.at(sums, own, rows)
        sizes = np.bincount(own, minlength=len(centres))
        centres[sizes > 0] = (sums[sizes > 0] / sizes[sizes > 0, None]).astype(np.float32)
    return centres


def fit(sample: np.ndarray, lists: int) -> Index:
    """Lists and codebooks from unit vectors."""
    centres = means(sample, lists)
    left = sample - centres[nearest(sample, centres)]
    width = sample.shape[1]
    limits = np.linspace(0, width, min(PARTS, width) + 1).astype(int)
    books = [means(left[:, a:b], CODES) for a, b in zip(limits[:-1], limits[1:], strict=True)]
    return Index(centres, books, limits)


def coded(index: Index, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of members; the part of their squared distances that no query changes; the coding errors."""
    centres = index.lists[own]
    left = rows - centres
    codes = np.empty((len(rows), len(index.books)), dtype=np.uint8)
    shown = np.empty_like(rows)
    for k, book in enumerate(index.books):
        a, b = index.limits[k], index.limits[k + 1]
        codes[:, k] = nearest(left[:, a:b], book)
        shown[:, a:b] = book[codes[:, k]]
    fixed = (shown * shown).sum(1) + 2 * (shown * centres).sum(1)
    return codes, fixed, np.linalg.norm(left - shown, axis=1)


def probes(index: Index, rows: np.ndarray, own: np.ndarray, reach: float) -> list[np.ndarray]:
    """Lists whose boundary with a row's own list is within `reach` of the row; its own is one of them."""
    far = squares(rows, index.lists)
    gaps = np.sqrt(squares(index.lists, index.lists))
    near = far - far[np.arange(len(rows)), own][:, None] <= 2 * reach * gaps[own]
    near[np.arange(len(rows)), own] = True
    return [np.flatnonzero(x) for x in near]


def distances(index: Index, queries: np.ndarray, centre: int, codes: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Squared asymmetric distances of queries and the coded members of a list."""
    out = ((queries - index.lists[centre]) ** 2).sum(1)[:, None] + fixed[None]
    for k, book in enumerate(index.books):
        table = queries[:, index.limits[k] : index.limits[k + 1]] @ book.T
        out -= 2 * table[:, codes[:, k]]
    return out


def _vectors(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """`id`, and the `code` of a vector with a direction: its doubles; else null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, usable = matrix(batch.column("v"), width)
            # a zero has one code
            found += 0.0
            codes = [x.tobytes() if ok else None for x, ok in zip(found, usable, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes, pa.binary())], ["id", "code"])

    plain = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return plain.mapInArrow(read, "id long, code binary")


def _table(column: pa.ChunkedArray | pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """Equally long binary values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _index(nodes: DataFrame, width: int, lists: int) -> Index:
    sample = nodes.orderBy(F.xxhash64("code"), "node").select("code").limit(SAMPLE).toArrow()
    return fit(unit(_table(sample["code"], width)), lists)


def _filed(nodes: DataFrame, index: Index, width: int, reach: float) -> DataFrame:
    """Nodes with their list, codes and the lists they ask."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = unit(_table(batch.column("code"), width))
            own = nearest(rows, index.lists)
            codes, fixed, error = coded(index, rows, own)
            asked = probes(index, rows, own, reach)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(own.astype(np.int32)),
                    pa.array([x.tobytes() for x in codes], pa.binary()),
                    pa.array(fixed.astype(np.float32)),
                    pa.array(error.astype(np.float32)),
                    pa.array([x.astype(np.int32) for x in asked], pa.list_(pa.int32())),
                ],
                [*batch.schema.names, "list", "parts", "fixed", "error", "asks"],
            )

    schema = "node long, code binary, copies long, list int, parts binary, fixed float, error float, asks array<int>"
    return nodes.select("node", "code", "copies").mapInArrow(file, schema)


def _grouped(filed: DataFrame) -> DataFrame:
    """Members and queries of each list, in groups of bounded size: (`list`, `m`, `q`)."""
    members = filed.groupBy("list").agg(F.count(F.lit(1)).alias("_m"))
    asked = filed.select(F.explode("asks").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("_q"))
    # a row for each list, of which there are at most LISTS
    sizes = asked.join(members, "list").select(
        "list", F.ceil(F.col("_m") / MEMBERS).cast("int").alias("_m"), F.ceil(F.col("_q") / QUERIES).cast("int").alias("_q")
    )
    sizes = F.broadcast(cut(sizes))
    dealt = F.pmod(F.xxhash64("node", F.lit(1)), F.col("_m")).cast("int"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("_q")).cast("int")
    one = filed.join(sizes, "list").select(
        "list", dealt[0].alias("m"), F.explode(F.sequence(F.lit(0), F.col("_q") - 1)).alias("q"),
        "node", "code", "copies", "parts", "fixed", "error",
    )
    other = filed.select("node", "code", F.explode("asks").alias("list")).join(sizes, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("m"), dealt[1].alias("q"),
        "node", "code", F.lit(None).cast("long").alias("copies"), F.lit(None).cast("binary").alias("parts"),
        F.lit(None).cast("float").alias("fixed"), F.lit(None).cast("float").alias("error"),
    )
    return one.unionByName(other)


def _matched(index: Index, width: int, cosine: float):
    limit = float(np.sqrt(2 - 2 * cosine))

    def match(group: pa.Table) -> pa.Table:
        is_member = np.asarray(group["parts"].is_valid())
        members, queries = group.filter(pa.array(is_member)), group.filter(pa.array(~is_member))
        out: dict[str, list[int | None]] = {"a": [], "b": [], "n": []}
        if members.num_rows and queries.num_rows:
            centre = members["list"][0].as_py()
            right, left = _table(members["code"], width), _table(queries["code"], width)
            names, ids = np.asarray(members["node"]), np.asarray(queries["node"])
            copies = np.asarray(members["copies"])
            codes = _table(members["parts"], len(index.books), np.uint8)
            within = (limit + np.asarray(members["error"]) + SLACK) ** 2
            fixed = np.asarray(members["fixed"])
            right = right / np.linalg.norm(right, axis=1, keepdims=True)
            left = left / np.linalg.norm(left, axis=1, keepdims=True)
            forest = Forest()
            for k in range(0, len(left), 256):
                some = left[k : k + 256]
                maybe = distances(index, some.astype(np.float32), centre, codes, fixed) <= within[None]
                places = np.flatnonzero(maybe.any(0))
                linked = maybe[:, places] & (some @ right[places].T >= cosine)
                linked &= ids[k : k + 256, None] != names[places][None]
                count = linked @ copies[places]
                rows = np.flatnonzero(count)
                if not len(rows):
                    continue
                out["a"] += ids[k + rows].tolist()
                out["b"] += [None] * len(rows)
                out["n"] += count[rows].tolist()
                row, column = spanning(linked)
                for x in rows:
                    forest.add(int(ids[k + x]), int(names[places[row[x]]]))
                for y in np.flatnonzero(linked.any(0)):
                    forest.add(int(names[places[y]]), int(names[places[column[y]]]))
            for a, b in forest.links:
                out["a"].append(a)
                out["b"].append(b)
                out["n"].append(0)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return match


def links(nodes: DataFrame, width: int, count: int, cosine: float = COSINE) -> DataFrame:
    """For distinct vectors (`node`, `code`, `copies`): rows (`a`, null, links to other nodes' rows) and (`a`, `b`, 0).

    The latter connect the nodes that are connected.
    """
    index = _index(nodes, width, int(min(LISTS, max(1, -(-count // LIST)))))
    reach = float(np.sqrt(2 - 2 * cosine) * min(1.0, MARGIN / np.sqrt(width)))
    groups = _grouped(cut(_filed(nodes, index, width, reach)))
    return groups.groupBy("list", "m", "q").applyInArrow(_matched(index, width, cosine), "a long, b long, n long")


def classes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row of `vectors`: its id as `key`, `n_links`, `component_id` and `kept`."""
    width = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    rows = _vectors(vectors, key, vector, max(1, width))
    # 128 bits stand for the vector
    rows = rows.withColumn("same", F.when(F.col("id").isNotNull(), F.md5("code")))
    nodes = rows.where("same is not null").groupBy("same")
    nodes = cut(nodes.agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("code").alias("code")))
    count = nodes.count()
    if count:
        found = cut(links(nodes, width, count, cosine))
        counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("_others"))
        labels = components(found.where("b is not null"))
    else:
        counts = vectors.sparkSession.createDataFrame([], "node long, _others long")
        labels = vectors.sparkSession.createDataFrame([], "node long, label long")
    # ids that several vectors share are one node
    nodes = nodes.select("same", "node", "copies").join(counts, "node", "left").join(labels, "node", "left")
    joined = rows.select("id", "same").join(nodes, "same", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "node", "id"))
    return joined.select(
        F.col("id").alias(key),
        F.coalesce(F.col("copies") - 1 + F.coalesce("_others", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
