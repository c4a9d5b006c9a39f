"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its shingles of five lower-case words. A shingle weighs its number of
occurrences times its inverse document frequency, scaled between `FLOOR` and 1: shingles in one text of
`COMMON` or fewer weigh 1 (in a table of fewer texts those in one text weigh what the scale says), and a shingle that all texts hold weighs the floor, so a group of copies stays
alike however large it is. Document frequencies are counted over all documents, in two steps: counts
of hashed cells show which cells can hold a common shingle, then the shingles of those cells are
counted exactly. At most `COMMON` times the mean number of shingles of a text can be common, whatever the
number of texts, so their table fits every task.

Consistent samples are cut into bands. Texts that agree in a band are candidates and are verified by
their weighted Jaccard similarity. No bucket is expanded into pairs: see `components.linked`. The
weight of the shingles that no other candidate has bounds a text's similarity to any other: a text whose bound is
too small needs no comparison, and the texts with the smallest share lead their buckets. Classes are the connected components of the verified links.

Equal texts are collapsed to one before. Defined cases: a text without a word is in a class of its
own row by row; a text of fewer than five words has one shingle of all of them; a null id counts as
the largest; the class id is the smallest id of the class.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.llm import spans
from labtrail.llm.common import cut, parts, whole_row
from labtrail.llm.components import Forest, Side, Tiles, components, linked, spanning
from labtrail.llm.substring_dedup import bounds

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
COMMON = 1000
FLOOR = 0.8
CELL_BITS = 22
RANGES = 64
ROUNDS = 2
#: Triples of random numbers that shingles are dealt to, as a power of two.
TABLE_BITS = 16


def shingles(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles' fingerprints, sorted, and how often they occur."""
    bodies = [b" ".join(x.lower().encode("utf-8", "replace").split()) for x in texts]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for low, high in spans.chunks([len(b) for b in bodies]):
        inside = [k for k in range(low, high) if bodies[k]]
        if not inside:
            yield from [none] * (high - low)
            continue
        data = np.frombuffer(b" ".join(bodies[k] for k in inside), np.uint8)
        starts, ends = bounds(data)
        prints = spans.Fingerprints(data)
        at = 0
        for k in range(low, high):
            if not bodies[k]:
                yield none
                continue
            n = bodies[k].count(b" ") + 1
            size = min(n, WORDS)
            yield np.unique(prints.of(starts[at : at + n - size + 1], ends[at + size - 1 : at + n]), return_counts=True)
            at += n


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[list[str]]:
    for at in range(0, batch.num_rows, 1000):
        yield [x or "" for x in batch.column(column).slice(at, 1000).to_pylist()]


#: Fingerprints, sorted, and weights of common shingles, and the weight of every other shingle.
Weights = tuple[np.ndarray, np.ndarray, float]


def common_shingles(docs: DataFrame, text: str) -> Weights:
    """Weights of the shingles in more than one of `COMMON` documents, and in two at least; all others weigh the same."""
    total = docs.count()
    least = max(1.0, total / COMMON)

    def scaled(n: np.ndarray) -> np.ndarray:
        idf = np.log(max(total, 1) / np.maximum(n, 1.0)) / np.log(COMMON)
        return FLOOR + (1.0 - FLOOR) * np.clip(idf, 0.0, 1.0)

    texts = docs.select(text)
    width = (1 << CELL_BITS) // RANGES

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int32)
        for batch in batches:
            for part in _texts(batch, 0):
                held = [(found >> np.uint64(64 - CELL_BITS)).astype(np.int32) for found, _ in shingles(part)]
                # in place: counts of this part alone would be as long as all cells
                np.add.at(counts, np.concatenate(held), 1)
        blobs = [counts[k * width : (k + 1) * width] for k in range(RANGES)]
        blobs = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in blobs]
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(blobs, pa.binary())], names=["range", "counts"])

    def heavy(rows: pd.DataFrame) -> pd.DataFrame:
        summed = np.zeros(width, np.int64)
        for blob in rows["counts"]:
            summed += np.frombuffer(pa.decompress(bytes(blob), width * 4, "zstd"), np.int32)
        return pd.DataFrame({"cell": np.flatnonzero(summed > least) + int(rows["range"].iloc[0]) * width})

    summed = texts.mapInArrow(cells, "range int, counts binary").groupBy("range").applyInPandas(heavy, "cell long")
    possible = np.zeros(1 << CELL_BITS, bool)
    possible[np.asarray(summed.toArrow()["cell"], np.int64)] = True

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.zeros(0, np.uint64)]
            for part in _texts(batch, 0):
                held += [found[possible[found >> np.uint64(64 - CELL_BITS)]] for found, _ in shingles(part)]
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(counts, pa.int64())], names=["print", "n"])

    counted = texts.mapInArrow(exact, "print long, n long").groupBy("print").agg(F.sum("n").alias("n"))
    table = counted.where(F.col("n") > least).toArrow()
    prints = np.asarray(table["print"], np.int64).astype(np.uint64)
    order = np.argsort(prints)
    return prints[order], scaled(np.asarray(table["n"], np.float64))[order], float(scaled(np.ones(1))[0])


def weights(found: np.ndarray, counts: np.ndarray, common: Weights) -> np.ndarray:
    prints, scale, other = common
    out = counts.astype(np.float64)
    if len(prints):
        at = np.minimum(np.searchsorted(prints, found), len(prints) - 1)
        return out * np.where(prints[at] == found, scale[at], other)
    return out * other


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """Random numbers of the method: r and c of Gamma(2, 1), b uniform; log of c, and for weight 1 the
    value that is minimised; odd factors that deal a shingle to another triple for every sample."""
    rng = np.random.default_rng(20)
    r = rng.gamma(2.0, 1.0, 1 << TABLE_BITS)
    log_c = np.log(rng.gamma(2.0, 1.0, 1 << TABLE_BITS))
    b = rng.random(1 << TABLE_BITS)
    factors = rng.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return r, log_c, b, log_c + r * b - r, factors


def signature(found: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Band keys of a weighted set: two sets agree in one sample with the probability of their similarity."""
    r, log_c, b, unit, factors = _tables()
    best = np.full(len(factors), np.inf)
    sample = np.zeros(len(factors), np.uint64)
    columns = np.arange(len(factors))
    other = weight != 1.0
    for part, plain in ((~other, True), (other, False)):
        inside = found[part]
        logs = np.log(weight[part])
        for at in range(0, len(inside), 4096):
            few = inside[at : at + 4096]
            deal = ((few[:, None] * factors) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            if plain:
                value = unit[deal]
                row = np.argmin(value, axis=0)
                name = few[row]
            else:
                step = np.floor(logs[at : at + 4096, None] / r[deal] + b[deal])
                value = log_c[deal] - r[deal] * (step - b[deal]) - r[deal]
                row = np.argmin(value, axis=0)
                name = few[row] + spans.mixed(step[row, columns].astype(np.int64).astype(np.uint64))
            lowest = value[row, columns]
            better = lowest < best
            best = np.where(better, lowest, best)
            sample = np.where(better, name, sample)
    keys = spans.mixed(sample + columns.astype(np.uint64)).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = spans.mixed(key * np.uint64(spans.FACTOR) + keys[:, k])
    return key.astype(np.int64)


def signed(docs: DataFrame, key: str, text: str, common: Weights) -> DataFrame:
    """`_key`, `_same`, `bands` of every row; no bands for a text without a word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = []
            for part in _texts(batch, 2):
                for found, counts in shingles(part):
                    bands.append(signature(found, weights(found, counts, common)) if len(found) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64()))], names=["_key", "_same", "bands"])

    rows = docs.select(spans.keyed(key), spans.digest(text).alias("_same"), F.col(text).alias("_text"))
    return rows.mapInArrow(sign, "_key long, _same string, bands array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets (sorted fingerprints, weights)."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][x], b[1][y]).sum()
    return float(shared / max(a[1].sum() + b[1].sum() - shared, 1e-30))


def verified(pairs: DataFrame, texts: DataFrame, common: Weights) -> DataFrame:
    """`a`, `b`, `distance` of pairs of nodes."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [[(f, weights(f, c, common)) for f, c in shingles(part.column(k).to_pylist())] for k in (2, 3)]
                out += [1.0 - similarity(x, y) for x, y in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "distance"])

    left = texts.select(F.col("node").alias("a"), F.col("_text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("_text").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return rows.mapInArrow(measure, "a long, b long, distance double")


def novelty(texts: DataFrame, common: Weights) -> DataFrame:
    """`node`, `weight` of the text, and `own`, the weight of its shingles that no other text has.

    Shingles travel as packed arrays; one that several texts of a task hold travels once, unnamed.
    """
    buckets = parts(texts.sparkSession, 16)
    kind = np.dtype([("print", "<u8"), ("node", "<i8"), ("weight", "<f4")])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for at, part in zip(range(0, batch.num_rows, 1000), _texts(batch, 1), strict=True):
                sets = [(f, weights(f, c, common)) for f, c in shingles(part)]
                some = nodes[at : at + len(part)]
                sizes = [len(f) for f, _ in sets]
                rows = np.empty(sum(sizes), kind)
                rows["print"] = np.concatenate([f for f, _ in sets])
                rows["weight"] = np.concatenate([w for _, w in sets])
                rows["node"] = np.repeat(some, sizes)
                rows = rows[np.argsort(rows["print"], kind="stable")]
                first = np.concatenate([[True], rows["print"][1:] != rows["print"][:-1]])
                again = np.append(~first[1:], False)
                rows["node"][again] = -1
                rows = rows[first]
                to = (rows["print"] % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(buckets + 1))
                whole = np.zeros(len(part), kind)
                whole["node"], whole["weight"] = some, [w.sum() for _, w in sets]
                blobs = [rows[order[edges[k] : edges[k + 1]]].tobytes() for k in range(buckets)]
                totals = [whole[some % buckets == k].tobytes() for k in range(buckets)]
                columns = [pa.array(range(buckets), pa.int32()), pa.array(blobs, pa.binary()), pa.array(totals, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "rows", "totals"])

    def meet(blobs: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(blobs.column("rows").to_pylist()), kind)
        rows = rows[np.argsort(rows["print"], kind="stable")]
        new = np.concatenate([[True], rows["print"][1:] != rows["print"][:-1], [True]]) if len(rows) else np.zeros(1, bool)
        alone = rows[new[:-1] & new[1:] & (rows["node"] >= 0)]
        node, index = np.unique(alone["node"], return_inverse=True)
        own = np.bincount(index, weights=alone["weight"], minlength=len(node))
        whole = np.frombuffer(b"".join(blobs.column("totals").to_pylist()), kind)
        return pa.Table.from_arrays(
            [
                pa.array(np.concatenate([whole["node"], node])),
                pa.array(np.concatenate([whole["weight"].astype(np.float64), np.zeros(len(node))])),
                pa.array(np.concatenate([np.zeros(len(whole)), own])),
            ],
            names=["node", "weight", "own"],
        )

    packed = texts.select("node", "_text").mapInArrow(make, "bucket int, rows binary, totals binary")
    met = packed.groupBy("bucket").applyInArrow(meet, "node long, weight double, own double")
    return met.groupBy("node").agg(F.sum("weight").alias("weight"), F.sum("own").alias("own"))


def tile_links(similar: float, common: Weights):
    """Comparison of all texts of two sides; see `components.Tiles`.

    The shared weight of two sets is an inner product: occurrence t of a shingle is a feature of its own, and a
    feature that both texts have gives its weight. Only features that both sides have are columns.
    """

    def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Names, sorted, and weights of each text's features, and the weight of the text."""
        out = []
        for found, counts in shingles(texts):
            one = weights(found, np.ones(len(found)), common)
            names, sizes = [found], [one]
            for t in range(1, int(counts.max(initial=0))):
                part = counts > t
                names.append(spans.mixed(found[part] + np.uint64(t) * np.uint64(spans.FACTOR)))
                sizes.append(one[part])
            out.append((np.concatenate(names), np.concatenate(sizes), float((one * counts).sum())))
        return out

    def shared_weight(one: list, other: list) -> np.ndarray:
        """Weight of the features that each two texts of two lists share."""
        out = np.zeros((len(one), len(other)))
        names, other_names = (np.concatenate([x[0] for x in side]) for side in (one, other))
        rows, other_rows = (np.repeat(np.arange(len(side)), [len(x[0]) for x in side]) for side in (one, other))
        sizes = np.concatenate([x[1] for x in one])
        both = np.intersect1d(names, other_names)
        for at in range(0, len(both), 2048):
            some = both[at : at + 2048]
            a, b = np.zeros((len(one), len(some))), np.zeros((len(other), len(some)))
            for grid, r, n, value in ((a, rows, names, sizes), (b, other_rows, other_names, None)):
                place = np.minimum(np.searchsorted(some, n), len(some) - 1)
                hit = some[place] == n
                grid[r[hit], place[hit]] = 1.0 if value is None else value[hit]
            out += a @ b.T
        return out

    def compare(one: Side, other: Side) -> list[tuple[int, int]]:
        (bucket, left, x), (other_bucket, right, y) = one, other
        # a text may be in many buckets
        texts = {int(n): t for nodes, side in ((left, x), (right, y)) for n, t in zip(nodes, side, strict=True)}
        sets = dict(zip(texts, features(list(texts.values())), strict=True))
        forest = Forest()
        places = defaultdict(lambda: ([], []))
        for k, buckets in enumerate((bucket, other_bucket)):
            for row, b in enumerate(buckets.tolist()):
                places[b][k].append(row)
        for rows, columns in places.values():
            if not rows or not columns:
                continue
            a, b = left[rows], right[columns]
            own, others = [sets[int(n)] for n in a], [sets[int(n)] for n in b]
            shared = shared_weight(own, others)
            whole = np.array([s[2] for s in own])[:, None] + np.array([s[2] for s in others])[None]
            alike = (shared >= (similar - 1e-9) * (whole - shared)) & (a[:, None] != b[None])
            row, column = spanning(alike)
            for k in np.flatnonzero(alike.any(1)):
                forest.add(int(a[k]), int(b[row[k]]))
            for k in np.flatnonzero(alike.any(0)):
                forest.add(int(b[k]), int(b[column[k]]))
        return forest.links

    return compare


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of `docs`: key, `class_id`, `n_leader_links` of its text, `copies` of its text,
    `_same`, and `keeps`, true on the rows of the text that stands for the class.

    `n_leader_links` counts the links that `components.linked` keeps to connect the class, not all texts that
    are as alike: members of a bucket that its leader connects are not compared with each other."""
    common = common_shingles(docs, text)
    rows = spans.written(signed(docs, key, text, common), "bands")
    groups = spans.owners(rows)
    nodes = rows.where(F.size("bands") > 0).join(groups.withColumnRenamed("owner", "_key"), ["_same", "_key"])
    nodes = nodes.dropDuplicates(["_same"]).withColumnRenamed("_key", "owner")
    # ids in the order of (owner, text): the smallest of a class stands for it
    nodes = spans.written(_numbered(nodes), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = spans.written(keys.join(shared, "bucket"), "shared")
    wanted = nodes.join(members.select("node").distinct(), "node").select("_same", "owner", "node")
    texts = spans.fetched(docs, key, text, wanted, "candidates")
    weight = novelty(texts, common).withColumn("order", F.col("own") / F.col("weight"))
    # a text that shares too little with all others has no link
    weight = weight.where(F.col("weight") - F.col("own") >= similar * F.col("weight") - 1e-6)
    members = spans.written(members.join(weight, "node"), "members")
    tiles = Tiles(texts.select("node", F.col("_text").alias("text")), tile_links(similar, common))
    links = linked(members, lambda pairs: verified(pairs, texts, common), 1.0 - similar + 1e-9, tiles, rounds)
    links = spans.written(links, "links")
    labels = components(links)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degrees = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_leader_links"))
    heads = nodes.select(F.col("node").alias("label"), F.col("owner").alias("class_key"))
    placed = nodes.select("_same", "node").join(labels, "node", "left").join(degrees, "node", "left")
    placed = placed.withColumn("label", F.coalesce("label", "node")).join(heads, "label")
    placed = placed.select("_same", "class_key", F.coalesce("n_leader_links", F.lit(0)).alias("n_leader_links"), (F.col("label") == F.col("node")).alias("head"))
    # written, so that the join's sides are both plain shuffles, of which a frequent text can be split
    judged = spans.written(groups.join(placed, "_same", "left"), "judged")
    out = rows.select("_key", "_same").join(judged, "_same")
    alone = F.col("class_key").isNull()  # no word
    return out.select(
        F.nullif(F.col("_key"), F.lit(spans.NO_KEY)).alias(key),
        F.nullif(F.when(alone, F.col("_key")).otherwise(F.col("class_key")), F.lit(spans.NO_KEY)).alias("class_id"),
        F.coalesce("n_leader_links", F.lit(0)).cast("long").alias("n_leader_links"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("copies"),
        "_same",
        (alone | (F.col("head") & (F.col("_key") == F.col("owner")))).alias("keeps"),
    )


def _numbered(nodes: DataFrame) -> DataFrame:
    """Add `node`, unique and in the order of (owner, text): a range sort, then a place in its partition."""
    ordered = cut(nodes.repartitionByRange("owner", "_same").sortWithinPartitions("owner", "_same"))
    return ordered.withColumn("node", F.monotonically_increasing_id())


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of `docs` that stay: one of each class, and every row without a word."""
    found = spans.written(classes(docs, key, text, similar).where("keeps").select(spans.keyed(key), "_same").distinct(), "keeps")
    marked = whole_row(docs, F.col(text).alias("_text"), spans.keyed(key), spans.digest(text).alias("_same"))
    worded = F.coalesce(F.col("_text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = marked.where(worded).join(found, ["_same", "_key"], "left_semi").dropDuplicates(["_same", "_key"])
    return kept.unionByName(marked.where(~worded)).select("_row.*")
