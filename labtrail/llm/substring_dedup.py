"""Removal of passages of many words that repeat across documents, by super-k-mers.

A word that lies in a window of `WINDOW` consecutive words that also starts in a document with a
smaller id is removed. Consecutive windows with one minimiser travel as one packed string to the
bucket of the minimiser; there the windows are sorted by fingerprint, equal neighbours are compared
word by word, and each window gets the smallest id it occurs under.

A minimiser in more than `HOT` items would bring them all into one bucket. Such items go as 128-bit
fingerprints: equal items are settled whole, and of each kind one is taken apart into windows. The
smallest id of a fingerprint is found by an aggregation that combines before the shuffle.

Equal texts are represented by the one with the smallest id; the others lose every word if they have
a window at all. Only items whose minimiser occurs in two different texts travel (see `spans`).

Defined cases: a null or empty text has no words; a null id counts as larger than any other, and
equal ids are not smaller than each other; repeated rows get equal results.
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

WINDOW = 50
#: Words of a minimiser; a window holds 35 of them.
MINIMISER = 16
#: Items of one minimiser that share a bucket at most.
HOT = 500
#: Buckets for each partition of a shuffle: a task holds one at a time.
BUCKETS = 16
EMPTY = hashlib.sha256(b"").hexdigest()


def plain(text: str) -> bytes:
    """Words of a text with one space between them."""
    return b" ".join(text.encode("utf-8", "replace").split())


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words of a byte array with single spaces between them."""
    gaps = np.flatnonzero(data == 32)
    return np.concatenate([[0], gaps + 1]), np.append(gaps, len(data))


def scan(texts: list[str]) -> list[tuple]:
    """For each text: words, digest of them all, fingerprints of its items' minimisers and their first windows."""
    bodies = [plain(x) for x in texts]
    out: list[tuple] = [(0, EMPTY, [], [])] * len(texts)
    for low, high in spans.chunks([len(b) for b in bodies]):
        inside = [k for k in range(low, high) if bodies[k]]
        if not inside:
            continue
        data = np.frombuffer(b" ".join(bodies[k] for k in inside), np.uint8)
        starts, ends = bounds(data)
        numbers = np.array([bodies[k].count(b" ") + 1 for k in inside])
        text_of = np.repeat(np.arange(len(inside)), numbers)
        first_word = np.cumsum(numbers) - numbers
        if len(starts) >= WINDOW:
            n = len(starts) - MINIMISER + 1
            prints = spans.Fingerprints(data).of(starts[:n], ends[MINIMISER - 1 :])
            whole = text_of[: len(starts) - WINDOW + 1] == text_of[WINDOW - 1 :]
            first, _, at = spans.items_of(prints, WINDOW - MINIMISER + 1, whole)
        else:
            prints, first, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        edges = np.searchsorted(first, np.append(first_word, len(starts)))
        for k, text in enumerate(inside):
            part = slice(edges[k], edges[k + 1])
            found = prints[at[part]].astype(np.int64), (first[part] - first_word[k]).astype(np.int32)
            out[text] = (int(numbers[k]), hashlib.sha256(bodies[text]).hexdigest(), *found)
    return out


def items_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: list[int]) -> list[tuple[int, int, int]]:
    """First window, number of windows and minimiser of the items of a text that begin at `places`."""
    prints = spans.Fingerprints(data).of(starts[: len(starts) - MINIMISER + 1], ends[MINIMISER - 1 :])
    first, number, at = spans.items_of(prints, WINDOW - MINIMISER + 1, np.ones(len(starts) - WINDOW + 1, bool))
    own = np.unique(np.searchsorted(first, np.array(places, np.int64), side="right") - 1)
    return list(zip(first[own].tolist(), number[own].tolist(), prints[at[own]].tolist(), strict=True))


def packed(rows: DataFrame, buckets: int) -> DataFrame:
    """Items that travel: rows (`bucket`, `blob`), each with many items as packed strings.

    An item is its text's md5, owner, first window, number of windows, and its words.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            held: dict[int, list] = defaultdict(list)
            for same, owner, places, text in zip(*(batch.column(c).to_pylist() for c in ("_same", "owner", "places", "_text")), strict=True):
                body = plain(text)
                data = np.frombuffer(body, np.uint8)
                starts, ends = bounds(data)
                for f, m, p in items_at(data, starts, ends, places):
                    words = body[starts[f] : ends[f + m + WINDOW - 2]]
                    held[p % buckets].append((same, owner, f, words))
            keys = sorted(held)
            blobs = [squeeze.compress(b"\n".join(b"%s %d %d %s" % (s.encode(), o, f, w) for s, o, f, w in held[k])) for k in keys]
            for at_ in range(0, len(keys), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at_ : at_ + 64], pa.int32()), pa.array(blobs[at_ : at_ + 64], pa.binary())], names=["bucket", "blob"]
                )

    return rows.select("_same", "owner", "places", "_text").mapInArrow(pack, "bucket int, blob binary")


def smallest(prints: np.ndarray, owner: np.ndarray, equal) -> np.ndarray:
    """For each window the smallest owner among equal windows.

    `equal(a, b)` compares windows word by word; windows of one fingerprint that differ are told
    apart by their words.
    """
    order = np.lexsort((owner, prints))
    sorted_prints = prints[order]
    new = np.concatenate([[True], sorted_prints[1:] != sorted_prints[:-1]])
    leads = np.flatnonzero(new)
    lead = leads[np.cumsum(new) - 1]
    out = np.empty(len(prints), owner.dtype)
    out[order] = owner[order[lead]]
    follow = np.flatnonzero(~new)
    wrong = follow[~equal(order[lead[follow]], order[follow])]
    for group in np.unique(lead[wrong]).tolist():
        members = order[lead == group]
        classes: dict[int, int] = {}
        for w in members.tolist():
            known = next((c for c in classes if equal(np.array([c]), np.array([w]))[0]), w)
            classes[known] = min(classes.get(known, owner[w]), owner[w])
            out[w] = known
        out[members] = [classes[c] for c in out[members].tolist()]
    return out


def judge_bucket(blobs: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Runs of windows (start, end in words) of a bucket's items that occur under a smaller owner."""
    same, owners, firsts, strings = [], [], [], []
    for blob in blobs:
        for line in zstandard.decompress(blob).split(b"\n"):
            s, o, f, words = line.split(b" ", 3)
            same.append(s.decode())
            owners.append(int(o))
            firsts.append(int(f))
            strings.append(words)
    data = np.frombuffer(b" ".join(strings), np.uint8)
    starts, ends = bounds(data)
    numbers = np.array([x.count(b" ") + 1 for x in strings])
    item = np.repeat(np.arange(len(strings)), numbers)
    first_word = np.cumsum(numbers) - numbers
    window = np.flatnonzero(item[: len(item) - WINDOW + 1] == item[WINDOW - 1 :])
    prints = spans.Fingerprints(data).of(starts[window], ends[window + WINDOW - 1])
    words = spans.Fingerprints(data, seed=2).of(starts, ends)  # a second fingerprint, word by word

    def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for k in range(WINDOW):
            out &= words[window[a] + k] == words[window[b] + k]
        return out

    own = np.array(owners, np.int64)[item[window]]
    hit = smallest(prints, own, equal) < own
    at = window[hit]
    if not len(at):
        return [], at, at
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (item[at[1:]] != item[at[:-1]])]))
    last = np.append(new[1:], len(at)) - 1
    which = item[at[new]]
    start = at[new] - first_word[which] + np.array(firsts)[which]
    return [same[k] for k in which.tolist()], start, start + at[last] - at[new] + WINDOW


def removed_runs(items: DataFrame) -> DataFrame:
    """`_same`, `start`, `end`: runs of words to remove, per distinct text; they may overlap."""

    def judge(rows: pa.Table) -> pa.Table:
        same, start, end = judge_bucket(rows.column("blob").to_pylist())
        columns = [pa.array(same, pa.string()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
        return pa.Table.from_arrays(columns, names=["_same", "start", "end"])

    return items.groupBy("bucket").applyInArrow(judge, "_same string, start int, end int")


def hot_runs(texts: DataFrame) -> DataFrame:
    """As `removed_runs`, for the items of frequent minimisers.

    Equal items are settled whole: all but those of the smallest owner go. Only one of each kind is
    then taken apart into windows.
    """
    schema = "ia long, ib long, owner long, _same string, start int, a array<long>, b array<long>"

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for same, owner, places, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                data = np.frombuffer(plain(text), np.uint8)
                starts, ends = bounds(data)
                one, two = spans.Fingerprints(data, 1), spans.Fingerprints(data, 2)
                for f, m, _ in items_at(data, starts, ends, places):
                    low, high = starts[f : f + m], ends[f + WINDOW - 1 : f + m + WINDOW - 1]
                    whole = [int(x.of(low[:1], high[-1:]).astype(np.int64)[0]) for x in (one, two)]
                    rows.append((*whole, owner, same, f, *[x.of(low, high).astype(np.int64) for x in (one, two)]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            names = ["ia", "ib", "owner", "_same", "start", "a", "b"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    hot = texts.where(F.size("hot") > 0).select("_same", "owner", "hot", "_text")
    rows = spans.written(hot.mapInArrow(items, schema), "hot-items")
    rows = rows.join(rows.groupBy("ia", "ib").agg(F.min("owner").alias("first")), ["ia", "ib"])
    whole = rows.where("first < owner").select("_same", "start", (F.col("start") + F.size("a") + WINDOW - 1).alias("end"))
    windows = rows.where("first = owner").select("_same", "owner", "start", F.posexplode(F.arrays_zip("a", "b")).alias("at", "x"))
    windows = windows.select("_same", "owner", (F.col("start") + F.col("at")).alias("start"), "x.a", "x.b")
    least = windows.groupBy("a", "b").agg(F.min("owner").alias("least"), F.max("owner").alias("most"))
    found = windows.join(least.where("least < most").drop("most"), ["a", "b"]).where("least < owner")
    return whole.unionByName(found.select("_same", "start", (F.col("start") + WINDOW).alias("end")))


def kept_words(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """`_same`, `n_removed`, `kept` (text that is left) of the distinct texts that lose words."""
    found = runs.groupBy("_same").agg(F.collect_list(F.struct("start", "end")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, intervals in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = plain(text).split(b" ")
                left, at, lost = [], 0, 0
                for start, end in spans.merged([(x["start"], x["end"]) for x in intervals]):
                    left += words[at:start]
                    lost, at = lost + end - start, end
                kept.append(b" ".join(left + words[at:]).decode())
                removed.append(lost)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["_same", "n_removed", "kept"])

    return texts.select("_same", "_text").join(found, "_same").mapInArrow(cut, "_same string, n_removed long, kept string")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: key, n_words, n_removed, kept_sha256, and the kept text if asked for."""
    rows = spans.listed(docs, key, text, scan, "words")
    groups = spans.owners(rows)
    found = spans.repeated(rows, apart=True, hot=HOT).join(groups.select("_same", "owner"), "_same")
    texts = spans.fetched(docs, key, text, found, "texts")
    runs = removed_runs(packed(texts, BUCKETS * parts(docs.sparkSession, 16)))
    changed = kept_words(texts, runs.unionByName(hot_runs(texts)))
    columns = ["_same", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")]
    changed = changed.select(*columns, *(["kept"] if with_text else []))
    # written, so that the join's sides are both plain shuffles, of which a frequent text can be split
    judged = spans.written(groups.join(changed, "_same", "left"), "kept")
    out = rows.select("_key", "_same", "size", "whole").join(judged, "_same")
    copy = (F.col("_key") > F.col("owner")) & (F.col("size") >= WINDOW)
    result = out.select(
        F.nullif(F.col("_key"), F.lit(spans.NO_KEY)).alias(key),
        F.col("size").alias("n_words"),
        F.when(copy, F.col("size")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    return result
