"""Removal of repeated lines, equal or within a few edits, by a segment-partition join.

Two lines within `EDITS` edits agree in at least one of `EDITS` + 1 segments of the shorter one, up to a
bounded shift. Every line is filed under its segments, with its length and the segment's number, and
probes the files of its own and the slightly smaller lengths with the substrings that can match there.
Lines that meet in a file are candidates; a banded bit-parallel edit distance verifies them. A file is
not expanded into pairs: see `components.linked`. Classes are the connected components of the links.

Of each class the line that comes first stays, by document id and line number; all others go.
Lines shorter than `MIN_CHARS` characters match only equal lines; lines without a word always stay.

Defined cases: a null text stays null and has no lines; a null id counts as the largest; rows that
agree in id and text are one document and lose the same lines; a text may be left empty. Very long
lines are compared like others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.llm import spans
from labtrail.llm.common import parts, restored, whole_row
from labtrail.llm.components import Forest, Side, Tiles, components, linked

EDITS = 2
MIN_CHARS = 30
ROUNDS = 2
#: Bytes of texts whose lines are filed at once, about; a task holds a few numbers for each.
FILED = 1 << 19
#: Characters of lines that are fingerprinted at once, about; a task holds some hundred bytes for each.
PRINTED = 1 << 18
#: Classes that characters are counted in, by their code; lines within `EDITS` edits have like counts.
CLASSES = 12


def segments(length: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of `count` segments of lines of given lengths; the last ones are longer by one."""
    small, longer = length // count, length % count
    out = []
    for k in range(count):
        extra = np.maximum(k - (count - longer), 0)
        out.append((k * small + extra, small + (k >= count - longer)))
    return out


def filings(start: np.ndarray, length: np.ndarray, edits: int = EDITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Substrings that lines are filed under or probe with: segment, shorter by, rows, from, to.

    A probe of a file of lines shorter by `less` needs only the shifts at which the segment could be
    the first, or the last, that agrees.
    """
    for less in range(edits + 1):
        filed = length - less
        for k, (at, size) in enumerate(segments(filed, edits + 1)):
            low = max(-k, less - (edits - k))
            high = min(k, less + (edits - k))
            for shift in range(low, high + 1):
                begin = at + shift
                rows = np.flatnonzero((begin >= 0) & (begin + size <= length) & (filed >= MIN_CHARS))
                yield k, less, rows, start[rows] + begin[rows], start[rows] + (begin + size)[rows]


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all files that each line meets, and the line's row."""
    prints, rows_of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in spans.chunks([len(x) for x in lines], PRINTED):
        found, rows = _signatures(lines[low:high])
        prints.append(found)
        rows_of.append(rows + low)
    return np.concatenate(prints), np.concatenate(rows_of)


def _signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in lines], np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(spans.mixed(points + np.uint64(1)) * spans._powers(spans.FACTOR, len(points)), out=sums[1:])
    inverse = spans._powers(spans.INVERSE, len(points) + 1)
    start = np.cumsum(length) - length
    prints, rows_of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k, less, rows, low, high in filings(start, length):
        found = spans.mixed((sums[high] - sums[low]) * inverse[low])
        file = (length[rows] - less).astype(np.uint64) * np.uint64(EDITS + 1) + np.uint64(k)
        prints.append(spans.mixed(found + file * np.uint64(spans.FACTOR)))
        rows_of.append(rows)
    return np.concatenate(prints), np.concatenate(rows_of)


def name(line: str) -> tuple[int, int]:
    """128-bit fingerprint of a line as two signed numbers."""
    number = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    high, low = number >> 64, number & spans.MASK
    return high - (1 << 64) * (high >> 63), low - (1 << 64) * (low >> 63)


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`_key`, `_same`, `lines`: the places and names of the lines with a word of every row, as a written table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = []
                for body in part.column(2).to_pylist():
                    found = enumerate((body or "").split("\n"))
                    out.append([{"pos": k, "hi": n[0], "lo": n[1]} for k, x in found if _worded(x) for n in (name(x),)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, kind)], names=["_key", "_same", "lines"])

    rows = docs.where(F.col(text).isNotNull()).select(spans.keyed(key), spans.digest(text).alias("_same"), F.col(text).alias("_text"))
    schema = "_key long, _same string, lines array<struct<pos: int, hi: long, lo: long>>"
    return spans.written(rows.mapInArrow(read, schema), "lines")


def _worded(line: str) -> bool:
    return bool(line.strip(" \t\n\x0b\x0c\r"))


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """Rows (`bucket`, `node`): files in which two different lines meet, and their lines (`hi` of the name)."""
    buckets = 4 * parts(docs.sparkSession, 16)  # a task holds one at a time

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in spans.chunks(pc.binary_length(batch.column(0)).to_pylist(), FILED):
                lines = {x for body in batch.column(0).slice(low, high - low).to_pylist() for x in body.split("\n") if len(x) >= MIN_CHARS}
                lines = sorted(x for x in lines if _worded(x))
                if not lines:
                    continue
                prints, rows = signatures(lines)
                nodes = np.array([name(x)[0] for x in lines], np.int64)[rows]
                to = (prints % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(buckets + 1))
                pairs = np.stack([prints.astype(np.int64), nodes], axis=1)[order]
                found = [k for k in range(buckets) if edges[k] < edges[k + 1]]
                blobs = [pairs[edges[k] : edges[k + 1]].tobytes() for k in found]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], names=["to", "pairs"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = np.frombuffer(b"".join(rows["pairs"]), "<i8").reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        if len(pairs) > 1:
            pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])]
        same = pairs[1:, 0] == pairs[:-1, 0]
        shared = np.zeros(len(pairs), bool)
        shared[1:] |= same
        shared[:-1] |= same
        return pd.DataFrame({"bucket": pairs[shared, 0], "node": pairs[shared, 1]})

    texts = docs.where(F.col(text).isNotNull()).select(text)
    return texts.mapInArrow(make, "to int, pairs binary").groupBy("to").applyInPandas(meet, "bucket long, node long")


def edit_distances(pairs: list[tuple[str, str]], most: int) -> np.ndarray:
    """Edit distances of pairs of strings, `most` + 1 for all above `most`.

    The band of 2 * `most` + 2 diagonals is one integer per pair, and one step handles a character of
    all pairs at once. What both strings start or end with is left out first.
    """
    short, long_ = [], []
    out = np.full(len(pairs), most + 1, np.int64)
    todo = []
    for k, (a, b) in enumerate(pairs):
        a, b = _trimmed(a, b)
        if len(a) < len(b):
            a, b = b, a
        if len(a) - len(b) > most:
            continue
        if len(a) <= most:
            out[k] = _plain_distance(a, b)
            continue
        todo.append((len(a), k))
        long_.append(a)
        short.append(b)
    order = sorted(range(len(todo)), key=lambda x: todo[x][0])
    for at in range(0, len(order), 512):
        some = order[at : at + 512]
        found = _banded([long_[x] for x in some], [short[x] for x in some], most)
        out[[todo[x][1] for x in some]] = np.minimum(found, most + 1)
    return out


def _trimmed(a: str, b: str) -> tuple[str, str]:
    n = min(len(a), len(b))
    head = _shared(a[:n], b[:n])
    a, b, n = a[head:], b[head:], n - head
    tail = _shared(a[len(a) - n :][::-1], b[len(b) - n :][::-1])
    return a[: len(a) - tail], b[: len(b) - tail]


def _shared(a: str, b: str) -> int:
    """Length of the common prefix of strings of one length."""
    if a == b:
        return len(a)
    low, high = 0, len(a)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _banded(pattern: list[str], text: list[str], most: int) -> np.ndarray:
    """Banded bit-parallel distances. A pattern is no shorter than its text, by `most` at most, and
    longer than `most`.

    Bit t of the band in column j stands for row j + most - width + 1 + t, the top bit for the band's
    lowest row. Until that row is the last, the distance is followed down its diagonal, then along the
    last row.
    """
    n, width = len(pattern), 2 * most + 2
    sizes = np.array([len(x) for x in pattern])
    columns = np.array([len(x) for x in text])
    rows = int(sizes.max()) + 2 * width
    letters = np.full((rows, n), 0xFFFFFFFF, np.uint32)  # no character
    against = np.full((int(columns.max()) + 1, n), 0xFFFFFFFE, np.uint32)
    for k in range(n):
        letters[width : width + sizes[k], k] = np.frombuffer(pattern[k].encode("utf-32-le", "surrogatepass"), "<u4")
        against[: columns[k], k] = np.frombuffer(text[k].encode("utf-32-le", "surrogatepass"), "<u4")
    full = np.int64((1 << width) - 1)
    plus = np.full(n, (full << np.int64(width - most - 1)) & full, np.int64)
    minus = np.zeros(n, np.int64)
    distance = np.full(n, most, np.int64)
    weights = (np.int64(1) << np.arange(width, dtype=np.int64))[:, None]
    for j in range(int(columns.max())):
        first = j + most - width + 1  # pattern place of bit 0
        equal = letters[width + first : 2 * width + first] == against[j]
        match = (equal * weights).sum(axis=0)
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & full
        up = (minus | ~(diagonal | plus)) & full
        down = diagonal & plus
        live = j < columns
        sliding = j < sizes - most
        along = np.clip(width - 2 - (j - (sizes - most)), 0, width - 1)
        step = np.where(sliding, 1 - ((diagonal >> (width - 1)) & 1), ((up >> along) & 1) - ((down >> along) & 1))
        distance += np.where(live, step, 0)
        plus = (down | ~((diagonal >> 1) | up)) & full
        minus = (diagonal >> 1) & up
    return distance


def measured(texts: DataFrame, edits: int):
    """Function that adds the edit `distance`, exact up to the limit, to pairs of nodes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = edit_distances(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)), edits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.astype(float))], names=["a", "b", "distance"])

    def measure(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("line").alias("x"))
        right = texts.select(F.col("node").alias("b"), F.col("line").alias("y"))
        rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        return rows.mapInArrow(compare, "a long, b long, distance double")

    return measure


def tile_links(edits: int):
    """Comparison of all lines of two sides; see `components.Tiles`.

    An edit changes the length by one at most and two of the counts of characters by one each, which
    leaves few pairs; of these, pairs that are connected already need no distance.
    """

    def profile(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in lines]
        counts = [np.bincount(x % CLASSES, minlength=CLASSES) for x in points]
        return np.array([len(x) for x in points]), np.array(counts, np.int32).reshape(-1, CLASSES)

    def compare(one: Side, other: Side) -> list[tuple[int, int]]:
        (bucket, left, x), (other_bucket, right, y) = one, other
        (sizes, counts), (other_sizes, other_counts) = profile(x), profile(y)
        order = np.argsort(other_bucket, kind="stable")
        low, high = (np.searchsorted(other_bucket[order], bucket, side) for side in ("left", "right"))
        forest = Forest()
        tested: set[tuple[int, int]] = set()
        ends = np.cumsum(high - low)
        at = 0
        while at < len(left):
            # rows of about a hundred thousand pairs
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 100_000, "right")))
            number = (high - low)[at:until]
            i = np.repeat(np.arange(at, until), number)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(low[at:until], number)]
            near = (np.abs(other_sizes[j] - sizes[i]) <= edits) & (right[j] != left[i])
            i, j = i[near], j[near]
            near = np.abs(other_counts[j] - counts[i]).sum(axis=1) <= 2 * edits
            i, j = i[near], j[near]
            for k in range(0, len(i), 2048):
                open_ = []
                for m, n in zip(i[k : k + 2048].tolist(), j[k : k + 2048].tolist(), strict=True):
                    a, b = int(left[m]), int(right[n])
                    pair = (a, b) if a < b else (b, a)
                    if pair not in tested and forest.root(a) != forest.root(b):
                        tested.add(pair)
                        open_.append((a, b, x[m], y[n]))
                found = edit_distances([p[2:] for p in open_], edits)
                for (a, b, _, _), distance in zip(open_, found.tolist(), strict=True):
                    if distance <= edits:
                        forest.add(a, b)
            at = until
        return forest.links

    return compare


def line_texts(docs: DataFrame, key: str, text: str, places: DataFrame) -> DataFrame:
    """`node`, `line` of the lines at `places` (`_key`, `_same`, `pos`, `node`), as a written table."""
    wanted = places.groupBy("_key", "_same").agg(F.collect_list(F.struct("pos", "node")).alias("at"))
    rows = docs.where(F.col(text).isNotNull()).select(spans.keyed(key), spans.digest(text).alias("_same"), F.col(text).alias("_text"))
    rows = rows.join(wanted, ["_key", "_same"]).withColumn("_lines", F.split("_text", "\n"))
    lines = rows.select("_lines", F.explode("at").alias("at")).select(F.col("at.node").alias("node"), F.col("_lines")[F.col("at.pos")].alias("line"))
    return spans.written(lines.dropDuplicates(["node"]), "line-texts")


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, rounds: int = ROUNDS) -> DataFrame:
    """`_key`, `_same`, `gone` (numbers of the lines to remove), for the texts that lose lines."""
    rows = occurrences(docs, key, text)
    lines = rows.select("_key", "_same", F.explode("lines").alias("x")).select("_key", "_same", "x.pos", "x.hi", "x.lo")
    place = F.struct("_key", "_same", "pos")
    firsts = spans.written(lines.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    members = spans.written(candidates(docs, text), "members")
    nodes = members.select(F.col("node").alias("hi")).distinct()
    places = firsts.join(nodes, "hi").groupBy("hi").agg(F.min("first").alias("first")).select("first.*", F.col("hi").alias("node"))
    texts = line_texts(docs, key, text, places)
    members = members.withColumn("order", F.col("node"))
    tiles = Tiles(texts.withColumnRenamed("line", "text"), tile_links(edits))
    links = spans.written(linked(members, measured(texts, edits), float(edits), tiles, rounds), "line-links")
    labels = components(links).withColumnRenamed("node", "hi")
    # the place of the line that stays, for lines that occur again or have a near twin
    named = firsts.join(labels, "hi", "left").where("label is not null or n > 1").select("hi", "lo", "first", "label")
    named = spans.written(named, "repeated-lines")
    stays = named.where("label is not null").groupBy("label").agg(F.min("first").alias("stays"))
    near = named.join(stays, "label").select("hi", "lo", "stays")
    again = named.where("label is null").select("hi", "lo", F.col("first").alias("stays"))
    judged = lines.join(near.unionByName(again), ["hi", "lo"])
    other = (F.col("_key") != F.col("stays._key")) | (F.col("_same") != F.col("stays._same")) | (F.col("pos") != F.col("stays.pos"))
    return judged.where(other).groupBy("_key", "_same").agg(F.collect_set("pos").alias("gone"))


def _kept_text() -> Column:
    """The lines whose number is not in `_gone`."""
    inner = "array_join(transform(array_except(sequence(0, size(l) - 1), _gone), i -> l[i]), '\\n')"
    return F.expr(f"element_at(transform(array(_lines), l -> {inner}), 1)")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with the text that is left, and `n_lines` and `n_removed`."""
    gone = removals(docs, key, text).withColumnRenamed("gone", "_gone")
    rows = whole_row(docs, spans.keyed(key), spans.digest(text).alias("_same"))
    # a text travels once, in its row; its lines are made behind the join
    rows = rows.join(gone, ["_key", "_same"], "left").withColumn("_text", F.col("_row").getField(text))
    rows = rows.withColumn("_lines", F.split("_text", "\n")).withColumns(
        {
            text: F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(_kept_text()),
            "n_lines": F.coalesce(F.size("_lines"), F.lit(0)).cast("long"),
            "n_removed": F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long"),
        }
    )
    return rows.select(*restored(rows, text, "n_lines", "n_removed"))
