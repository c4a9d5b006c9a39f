"""Passages that repeat: against brute force over every window."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from labtrail.llm import spans, substring_dedup, suffix_dedup
from tests.llm.common import FOLDER, docs, empty, prose, rows, words


def by_words(data):
    """doc rows (id, text) -> sorted (id, n_words, n_removed, digest)."""
    big = 1 << 62
    first, texts = {}, [(big if i is None else i, words(t)) for i, t in data]
    for i, w in texts:
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            first[x] = min(first.get(x, big), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((None if i == big else i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def by_bytes(data):
    count, texts = Counter(), [(i, (t or "").encode()) for i, t in data]
    for _, b in texts:
        count.update(b[k : k + 400] for k in range(len(b) - 399))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


OPERATORS = [(substring_dedup.dedup, by_words), (suffix_dedup.dedup, by_bytes)]


@pytest.mark.parametrize(("operator", "brute"), OPERATORS)
def test_cases(spark, operator, brute):
    found = sorted(map(tuple, operator(docs(spark)).collect()), key=repr)
    assert found == brute([r[:2] for r in rows()])


@pytest.mark.parametrize(("operator", "brute"), OPERATORS)
def test_table(spark, operator, brute):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, operator(table).collect()), key=repr) == brute([tuple(r) for r in table.collect()])


@pytest.mark.parametrize(("operator", "brute"), OPERATORS)
def test_empty(spark, operator, brute):
    assert operator(empty(spark)).count() == 0


@pytest.mark.parametrize(("operator", "brute"), OPERATORS)
def test_shared_passage(spark, operator, brute):
    """One passage in every document, at other places, and inside one document twice."""
    passage = prose(99, 130).replace("\n", " ")
    data = [(k, f"{prose(k + 200, 30 + k)} {passage} {prose(k + 400, 40)}") for k in range(40)]
    data.append((77, f"{passage} {prose(7, 20)} {passage}"))
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, operator(table).collect()), key=repr) == brute(data)


@pytest.mark.parametrize(("operator", "brute"), OPERATORS)
def test_long_texts_are_read_in_segments(spark, operator, brute, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 5000)
    long = prose(31, 3000)
    data = [(1, long), (2, prose(32, 100) + " " + long[2000:9000]), (3, prose(33, 500))]
    scan = suffix_dedup.scan if operator is suffix_dedup.dedup else substring_dedup.scan
    found = scan([t for _, t in data])
    assert set(found[0][2].tolist()) & set(found[1][2].tolist())


def test_frequent_minimisers(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    test_shared_passage(spark, substring_dedup.dedup, by_words)


def test_kept_text(spark):
    kept = {r.doc_id: r.kept for r in substring_dedup.dedup(docs(spark), with_text=True).collect()}
    assert kept[2] == ""
    left = {r.doc_id: r.kept for r in suffix_dedup.dedup(docs(spark), with_bytes=True).collect()}
    assert bytes(left[1]) == b""


def test_merge_of_runs():
    rng = np.random.default_rng(0)
    runs, everything = [], []
    for _ in range(5):
        run = sorted(bytes(rng.integers(97, 99, rng.integers(1, 12)).astype(np.uint8)) for _ in range(40))
        everything += run
        coded = suffix_dedup.front_coded([(x, b"left", "0" * 32, 3, 1) for x in run])
        assert [x for x, _, _ in suffix_dedup.decoded(coded)] == run
        runs.append(suffix_dedup.decoded(coded))
    before = b""
    merged = []
    for suffix, shared, payload in suffix_dedup.merge(runs):
        assert shared == suffix_dedup.common(before, suffix)
        assert payload == (b"left", "0" * 32, 3, 1)
        merged.append(suffix)
        before = suffix
    assert merged == sorted(everything)


def test_equal_fingerprints_are_told_apart():
    prints = np.array([5, 5, 5, 7], np.uint64)
    owner = np.array([3, 1, 2, 9], np.int64)
    kinds = np.array([0, 1, 0, 2])
    found = substring_dedup.smallest(prints, owner, lambda a, b: kinds[a] == kinds[b])
    assert found.tolist() == [2, 1, 2, 9]


def test_lowest():
    values = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) << np.uint64(1)
    found = spans.lowest(values, 35)
    assert found.tolist() == [k + int(np.argmin(values[k : k + 35] >> np.uint64(24))) for k in range(466)]


def test_lowest_beyond_the_place_bits(monkeypatch):
    """Arrays longer than a place's bits can say: the same places as from one piece."""
    rng = np.random.default_rng(8)
    values = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    values[rng.integers(0, 5000, 2000)] = values[0]  # ties
    wanted = [int(k + np.argmin(values[k : k + 35] >> np.uint64(spans.PLACE_BITS))) for k in range(5000 - 34)]
    assert spans.lowest(values, 35).tolist() == wanted
    bits = spans.PLACE_BITS
    coarse = values >> np.uint64(bits) << np.uint64(bits)
    monkeypatch.setattr(spans, "PLACE_BITS", 8)
    assert spans.lowest(coarse, 35).tolist() == wanted


def test_passages_of_texts_beyond_the_place_bits(spark, monkeypatch):
    from labtrail.llm import substring_dedup

    data = [(1, prose(1, 3000)), (2, prose(2, 500) + " " + prose(1, 3000)[4000:9000] + " " + prose(3, 900))]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    wanted = sorted(tuple(r) for r in substring_dedup.dedup(frame).collect())
    assert wanted[1][2] > 300
    monkeypatch.setattr(spans, "PLACE_BITS", 10)
    assert sorted(tuple(r) for r in substring_dedup.dedup(frame).collect()) == wanted
