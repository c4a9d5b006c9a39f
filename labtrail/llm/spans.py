"""Common steps of the operators that find long equal passages.

A window is a run of a fixed number of units (bytes or words). Its minimiser is the run of fewer units
inside it with the smallest fingerprint. Equal windows have equal minimisers, so a window whose
minimiser occurs once in the corpus occurs once, too. Consecutive windows with one minimiser are kept
together as an item.

Texts are read twice: once to list every text's minimisers, and once to fetch the texts that have a
minimiser that occurs again. Equal texts are collapsed to one, known by md5, before anything else, so
a group of copies costs its rows, not its texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import parts, scratch

MASK = (1 << 64) - 1
#: Odd factor of the polynomial fingerprints modulo 2**64, and its inverse.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
#: Bytes that are fingerprinted at once, about; bounds the memory of a task.
CHUNK = 1 << 20
PLACE_BITS = 24
#: Stands for a null key while rows are matched; larger than any other.
NO_KEY = (1 << 63) - 1


@lru_cache(maxsize=2)
def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: dict[int, np.ndarray] = {}


def _powers(factor: int, n: int) -> np.ndarray:
    have = _POWERS.get(factor)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + (CHUNK >> 2)), factor, np.uint64)
        steps[0] = 1
        have = _POWERS[factor] = np.multiply.accumulate(steps)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Fingerprints:
    """64-bit fingerprints of any runs of a byte array, from running sums."""

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_letters(seed)[data] * _powers(FACTOR, n), out=self.sums[1:])
        self.inverse = _powers(INVERSE, n + 1)

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each `width` consecutive fingerprints, the first one of equals.

    A key has `PLACE_BITS` for the place; longer arrays are read in overlapping pieces.
    """
    n, most = len(values), 1 << PLACE_BITS
    if n > most:
        # a piece has `most - width + 1` whole windows
        return np.concatenate([lowest(values[k : k + most], width) + k for k in range(0, n - width + 1, most - width + 1)])
    keys = (values >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, MASK, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    return (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def items_of(prints: np.ndarray, width: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of consecutive marked windows with one minimiser: first window, number, minimiser's place."""
    if len(prints) < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    place = lowest(prints, width)
    place[~marked] = -1
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    number = np.diff(np.append(first, len(place)))
    at = place[first]
    real = at >= 0
    return first[real], number[real], at[real]


def chunks(sizes: list[int], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together."""
    first, total = 0, 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield first, k
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def keyed(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("_key")


def digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def listed(docs: DataFrame, key: str, text: str, scan: Callable, name: str) -> DataFrame:
    """One row per row of `docs`, without its text, as a written table: `_key`, `_same` (md5 of the
    text), `size` (units), `whole` (digest of the unchanged result), `prints` and `places` of its items.

    `scan` takes a list of texts and gives for each (size, whole, prints, places).
    """
    schema = "_key long, _same string, size long, whole string, prints array<long>, places array<int>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = scan([x or "" for x in part.column(2).to_pylist()])
                columns = [part.column(0), part.column(1)]
                columns += [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())]
                columns += [pa.array([x[2] for x in found], pa.list_(pa.int64())), pa.array([x[3] for x in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["_key", "_same", "size", "whole", "prints", "places"])

    rows = docs.select(keyed(key), digest(text).alias("_same"), F.col(text).alias("_text"))
    return written(rows.mapInArrow(read, schema), name)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def owners(rows: DataFrame) -> DataFrame:
    """One row per distinct text: `_same`, `owner` (smallest key), `copies`."""
    return rows.groupBy("_same").agg(F.min("_key").alias("owner"), F.count(F.lit(1)).alias("copies"))


def repeated(rows: DataFrame, apart: bool, hot: int = 1 << 62) -> DataFrame:
    """Places of the items whose minimiser occurs again, per distinct text: `_same`, `places`, `hot`.

    With `apart`, only minimisers that occur in two different texts count. `hot` lists the places of
    minimisers that occur more than `hot` times, `places` the others. Minimisers are counted as
    packed arrays, combined before the shuffle; a frequent one is then a hot key of a join only, which
    adaptive execution splits.
    """
    buckets = parts(rows.sparkSession, 16)
    one = rows.where(F.size("prints") > 0).select("_same", "prints", "places", F.xxhash64("_same").alias("_text"))
    one = one.dropDuplicates(["_same"])

    def combined(found: np.ndarray) -> np.ndarray:
        """Rows (minimiser, smallest text, largest text, number), one per minimiser."""
        found = found[np.argsort(found[:, 0], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], found[1:, 0] != found[:-1, 0]]))
        columns = [found[first, 0], np.minimum.reduceat(found[:, 1], first), np.maximum.reduceat(found[:, 2], first)]
        return np.stack([*columns, np.add.reduceat(found[:, 3], first)], axis=1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0)
            numbers = np.diff(prints.offsets.to_numpy())
            text = np.repeat(batch.column(1).to_numpy(), numbers)
            if not len(text):
                continue
            found = combined(np.stack([prints.flatten().to_numpy(), text, text, np.ones(len(text), np.int64)], axis=1))
            to = (found[:, 0].astype(np.uint64) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(buckets + 1))
            full = [k for k in range(buckets) if edges[k] < edges[k + 1]]
            blobs = [found[order[edges[k] : edges[k + 1]]].tobytes() for k in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "items"])

    def meet(blobs: pa.Table) -> pa.Table:
        found = combined(np.frombuffer(b"".join(blobs.column("items").to_pylist()), "<i8").reshape(-1, 4))
        often = found[found[:, 1] != found[:, 2] if apart else found[:, 3] > 1]
        return pa.Table.from_arrays([pa.array(often[:, 0]), pa.array(often[:, 3] > hot)], names=["print", "hot"])

    counted = one.select("prints", "_text").mapInArrow(make, "bucket int, items binary").groupBy("bucket")
    often = counted.applyInArrow(meet, "print long, hot boolean")
    items = one.select("_text", F.explode(F.arrays_zip("prints", "places")).alias("x"))
    items = items.select("_text", F.col("x.prints").alias("print"), F.col("x.places").alias("place")).join(often, "print")
    # an array leaves null out
    lists = [F.collect_list(F.when(F.col("hot") == is_hot, F.col("place"))).alias(name) for name, is_hot in (("places", False), ("hot", True))]
    return items.groupBy("_text").agg(*lists).join(one.select("_same", "_text"), "_text").select("_same", "places", "hot")


def fetched(docs: DataFrame, key: str, text: str, found: DataFrame, name: str) -> DataFrame:
    """One copy of each distinct text in `found` (`_same`, `owner` and others), as a written table.

    Texts travel by md5 and key, so the copies of a frequent text do not meet in one task.
    """
    texts = docs.where(F.col(text).isNotNull()).select(keyed(key), digest(text).alias("_same"), F.col(text).alias("_text"))
    texts = texts.join(found.withColumnRenamed("owner", "_key"), ["_same", "_key"]).dropDuplicates(["_same", "_key"])
    return written(texts.withColumnRenamed("_key", "owner"), name)


def merged(intervals: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of the union of [start, end) intervals."""
    out: list[list[int]] = []
    for start, end in sorted(intervals):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out
