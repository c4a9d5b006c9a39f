"""Removal of long byte strings that occur again anywhere, by a distributed merge sort of suffixes.

Every byte covered by a string of `WINDOW` bytes that also starts elsewhere, in the same document or
another, is removed. Suffixes start at anchors: the minimisers of the windows (see `spans`), about one
byte in a hundred. Every window holds its anchor, so windows are equal exactly if they have equal bytes
before and after equal anchors; sorting the anchors' suffixes finds the second, and the bytes before
the anchor, which travel along, decide the first. Sorting all suffixes would move 400 bytes for each
byte of text.

Each task sorts its suffixes and sends every bucket a front-coded run: a suffix is stored as the length
of the prefix it shares with the one before and the rest. A bucket merges its runs by a loser tree that
keeps, for every loser, the length of its common prefix with the last output: the longer one wins
without a look at the bytes, and only equal lengths compare, from there on. The merge also gives
the common prefix of neighbours, which splits the order into clusters that share an anchor.

Equal texts are represented by one; if it has a window, all its copies are removed whole.

Defined cases: a null or empty text has no bytes, and nothing is removed; rows that repeat an id are
documents of their own; null ids are kept.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labtrail.llm import spans
from labtrail.llm.common import parts

WINDOW = 400
#: Bytes of an anchor's fingerprint; a window holds 201 of them.
ANCHOR = 200
#: Buckets for each partition of a shuffle: a task holds one at a time.
BUCKETS = 8
EMPTY = hashlib.sha256(b"").hexdigest()
#: Cells (records x offsets) of a cluster that are looked at together.
CELLS = 1 << 22


def text_items(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items of one text: first window, number of windows, anchor, fingerprint of the anchor.

    Long texts are read in overlapping segments, so memory does not grow with them.
    """
    found = []
    for at in range(0, max(len(data) - WINDOW + 1, 0), spans.CHUNK):
        part = data[at : at + spans.CHUNK + WINDOW - 1]
        n = len(part) - ANCHOR + 1
        prints = spans.Fingerprints(part).of(slice(0, n), slice(ANCHOR, None))
        first, number, place = spans.items_of(prints, WINDOW - ANCHOR + 1, np.ones(len(part) - WINDOW + 1, bool))
        found.append((first + at, number, place + at, prints[place]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def scan(texts: list[str]) -> list[tuple]:
    """For each text: bytes, digest, fingerprints of its anchors and the first windows of their items."""
    bodies = [x.encode("utf-8", "replace") for x in texts]
    none = np.zeros(0, np.int64), np.zeros(0, np.int32)
    out = [(len(b), hashlib.sha256(b).hexdigest(), *none) for b in bodies]
    for low, high in spans.chunks([len(b) for b in bodies]):
        inside = [k for k in range(low, high) if len(bodies[k]) >= WINDOW]
        if not inside:
            continue
        if len(inside) == 1:
            first, _, _, prints = text_items(np.frombuffer(bodies[inside[0]], np.uint8))
            out[inside[0]] = (*out[inside[0]][:2], prints.astype(np.int64), first.astype(np.int32))
            continue
        data = np.frombuffer(b"".join(bodies[k] for k in inside), np.uint8)
        sizes = np.array([len(bodies[k]) for k in inside])
        begins = np.cumsum(sizes) - sizes
        prints = spans.Fingerprints(data).of(slice(0, len(data) - ANCHOR + 1), slice(ANCHOR, None))
        whole = np.ones(len(data) - WINDOW + 1, bool)
        for end in np.cumsum(sizes)[:-1]:
            whole[max(0, end - WINDOW + 1) : end] = False
        first, _, place = spans.items_of(prints, WINDOW - ANCHOR + 1, whole)
        edges = np.searchsorted(first, np.append(begins, len(data)))
        for k, text in enumerate(inside):
            part = slice(edges[k], edges[k + 1])
            out[text] = (*out[text][:2], prints[place[part]].astype(np.int64), (first[part] - begins[k]).astype(np.int32))
    return out


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of two strings that share their first `at` bytes."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_coded(records: list[tuple[bytes, bytes, str, int, int]]) -> bytes:
    """A sorted run as bytes. A record is (suffix, bytes before it, md5 of the text, first window, number)."""
    records.sort(key=lambda r: r[:2])
    names = sorted({r[2] for r in records})
    index = {x: k for k, x in enumerate(names)}
    numbers, tails, lefts, previous = [], [], [], b""
    for suffix, left, same, first, number in records:
        shared = common(previous, suffix)
        numbers.append((shared, len(suffix) - shared, len(left), index[same], first, number))
        tails.append(suffix[shared:])
        lefts.append(left)
        previous = suffix
    head = np.array([len(records), len(names), sum(map(len, tails))], "<i8").tobytes()
    body = head + np.array(numbers, "<i4").tobytes() + "".join(names).encode() + b"".join(tails) + b"".join(lefts)
    return zstandard.ZstdCompressor(level=1).compress(body)


def decoded(run: bytes) -> Iterator[tuple[bytes, int, tuple[bytes, str, int, int]]]:
    """Suffix, prefix shared with the one before, and (bytes before, md5, first window, number)."""
    body = zstandard.decompress(run)
    n, names, tails = np.frombuffer(body[:24], "<i8").tolist()
    numbers = np.frombuffer(body, "<i4", n * 6, 24).reshape(n, 6).tolist()
    at = 24 + n * 24
    md5 = [body[at + 32 * k : at + 32 * k + 32].decode() for k in range(names)]
    at += 32 * names
    left_at = at + tails
    suffix = b""
    for shared, tail, left, same, first, number in numbers:
        suffix = suffix[:shared] + body[at : at + tail]
        yield suffix, shared, (body[left_at : left_at + left], md5[same], first, number)
        at += tail
        left_at += left


def merge(runs: list[Iterator]) -> Iterator[tuple[bytes, int, tuple]]:
    """Records of sorted runs in order, each with its common prefix with the one before."""
    size = 1
    while size < len(runs):
        size *= 2
    suffixes: list[bytes | None] = [None] * size
    shared, payloads = [0] * size, [None] * size
    done = object()

    def advance(k: int) -> None:
        record = next(runs[k], done) if k < len(runs) else done
        if record is done:
            suffixes[k] = None
        else:
            suffixes[k], shared[k], payloads[k] = record

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser. Both know their common prefix with the last output."""
        x, y = suffixes[a], suffixes[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        length = common(x, y, shared[a])
        if x[length:] <= y[length:]:
            shared[b] = length
            return a, b
        shared[a] = length
        return b, a

    for k in range(size):
        advance(k)
    losers = [0] * (2 * size)
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    winner = winners[1]
    while suffixes[winner] is not None:
        yield suffixes[winner], shared[winner], payloads[winner]
        advance(winner)
        node = (winner + size) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1


def covered(suffixes: list[bytes], shared: list[int], payloads: list[tuple]) -> Iterator[tuple[str, int, int]]:
    """Runs of bytes (md5, start, end) of a cluster's records that are in windows which occur twice.

    A window is named by its offset, the number of bytes before the anchor. Records whose window at an
    offset is equal share a class of suffixes, as far as the window goes, and a class of what is
    before the anchor; both orders give the classes by counting short common prefixes.
    """
    n = len(suffixes)
    least, most = [], []
    for left, _, _, number in payloads:
        most.append(len(left))
        least.append(len(left) - number + 1)
    if n == 2:
        back = common(payloads[0][0][::-1], payloads[1][0][::-1])
        low = max(WINDOW - shared[1], least[0], least[1], 0)
        if low <= back:
            for left, same, first, _ in payloads:
                yield same, first + len(left) - back, first + len(left) - low + WINDOW
        return
    before = [p[0][::-1] for p in payloads]
    order = sorted(range(n), key=before.__getitem__)
    back = np.array([0] + [common(before[a], before[b]) for a, b in zip(order, order[1:], strict=False)])
    ahead = np.array([0, *shared[1:]])
    order, low, high = np.array(order), np.array(least), np.array(most)
    width = max(1, CELLS // n)
    hits = []
    for at in range(0, ANCHOR + 1, width):
        offsets = np.arange(at, min(at + width, WINDOW - ANCHOR + 1))
        after = np.cumsum(ahead[:, None] < WINDOW - offsets, axis=0)
        ahead_of = np.empty((n, len(offsets)), np.int64)
        ahead_of[order] = np.cumsum(back[:, None] < offsets, axis=0)
        keys = after.astype(np.int64) * (n + 1) + ahead_of
        real = (low[:, None] <= offsets) & (offsets <= high[:, None])
        keys[~real] = -1 - np.broadcast_to(np.arange(n)[:, None], keys.shape)[~real]  # equal to no other
        rank = np.argsort(keys, axis=0, kind="stable")
        ranked = np.take_along_axis(keys, rank, axis=0)
        twin = ranked[1:] == ranked[:-1]
        hit = np.zeros(keys.shape, bool)
        flags = np.zeros(keys.shape, bool)
        flags[1:] |= twin
        flags[:-1] |= twin
        np.put_along_axis(hit, rank, flags, axis=0)
        hits.append(hit)
    hit = np.concatenate(hits, axis=1)
    edges = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    for row, begin, (row_, end) in zip(*np.nonzero(edges == 1), zip(*np.nonzero(edges == -1), strict=True), strict=True):
        left, same, first, _ = payloads[row]
        anchor = first + len(left)
        yield same, int(anchor - end + 1), int(anchor - begin + WINDOW)


def runs_of(texts: DataFrame, buckets: int) -> DataFrame:
    """Front-coded sorted runs: rows (`bucket`, `run`)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list] = defaultdict(list)
            for same, places, text in zip(*(batch.column(c).to_pylist() for c in ("_same", "places", "_text")), strict=True):
                body = text.encode("utf-8", "replace")
                first, number, anchor, prints = text_items(np.frombuffer(body, np.uint8))
                own = np.unique(np.searchsorted(first, np.array(places), side="right") - 1)
                for f, m, a, p in zip(*(x[own].tolist() for x in (first, number, anchor, prints)), strict=True):
                    held[p % buckets].append((body[a : f + m - 1 + WINDOW], body[f:a], same, f, m))
            keys = sorted(held)
            for at in range(0, len(keys), 16):
                runs = [front_coded(held.pop(k)) for k in keys[at : at + 16]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 16], pa.int32()), pa.array(runs, pa.binary())], names=["bucket", "run"])

    return texts.select("_same", "places", "_text").mapInArrow(make, "bucket int, run binary")


def removed_runs(runs: DataFrame) -> DataFrame:
    """`_same`, `start`, `end`: runs of bytes to remove, per distinct text; they may overlap."""

    def judge(rows: pa.Table) -> pa.Table:
        found: list[tuple[str, int, int]] = []
        suffixes, shared, payloads = [], [], []
        for suffix, length, payload in merge([decoded(x) for x in rows.column("run").to_pylist()]):
            if length < ANCHOR and suffixes:
                if len(suffixes) > 1:
                    found += covered(suffixes, shared, payloads)
                suffixes, shared, payloads = [], [], []
            suffixes.append(suffix)
            shared.append(length)
            payloads.append(payload)
        if len(suffixes) > 1:
            found += covered(suffixes, shared, payloads)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.int32(), pa.int32())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["_same", "start", "end"])

    return runs.groupBy("bucket").applyInArrow(judge, "_same string, start int, end int")


def kept_bytes(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """`_same`, `n_removed`, `n_spans`, `kept` (bytes that are left) of the texts that lose bytes."""
    found = runs.groupBy("_same").agg(F.collect_list(F.struct("start", "end")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, number = [], [], []
            for text, intervals in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                body = text.encode("utf-8", "replace")
                left, at, lost = [], 0, 0
                joined = spans.merged([(x["start"], x["end"]) for x in intervals])
                for start, end in joined:
                    left.append(body[at:start])
                    lost, at = lost + end - start, end
                kept.append(b"".join(left) + body[at:])
                removed.append(lost)
                number.append(len(joined))
            columns = [batch.column(0), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_same", "n_removed", "n_spans", "kept"])

    schema = "_same string, n_removed long, n_spans long, kept binary"
    return texts.select("_same", "_text").join(found, "_same").mapInArrow(cut, schema)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row per row of `docs`: key, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if
    asked for (null where nothing is removed)."""
    rows = spans.listed(docs, key, text, scan, "bytes")
    groups = spans.owners(rows)
    found = spans.repeated(rows, apart=False).join(groups.select("_same", "owner"), "_same")
    texts = spans.fetched(docs, key, text, found, "texts")
    changed = kept_bytes(texts, removed_runs(runs_of(texts, BUCKETS * parts(docs.sparkSession, 16))))
    changed = changed.withColumn("kept_sha256", F.sha2("kept", 256))
    changed = changed if with_bytes else changed.drop("kept")
    # written, so that the join's sides are both plain shuffles, of which a frequent text can be split
    judged = spans.written(groups.join(changed, "_same", "left"), "kept")
    out = rows.select("_key", "_same", "size", "whole").join(judged, "_same")
    copy = (F.col("copies") > 1) & (F.col("size") >= WINDOW)
    return out.select(
        F.nullif(F.col("_key"), F.lit(spans.NO_KEY)).alias(key),
        F.col("size").alias("n_bytes"),
        F.when(copy, F.col("size")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_bytes else []),
    )
