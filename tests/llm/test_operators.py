"""Search, language, quality, mixing, archives, packing and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labtrail.llm import langid, mixing, neighbours, packing, quality, queries, warc
from labtrail.llm.common import scratch
from tests.llm.common import FOLDER, docs, empty, prose, rows, words
from tests.oracle import compare, connect


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_oracle(spark, key):
    message, _, _ = compare(spark, connect(FOLDER), FOLDER, key, queries.QUERIES[key], queries.ORACLES[key])
    assert message is None, message


# nearest neighbours


def nearest(data, n=20):
    """Rows (query, rank, id, score) by comparing each query with all rows."""
    fine = [(i, np.array(v, float)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, a in fine:
        if q % 20 == 0:
            best = sorted(((-float(a @ b), i) for i, b in fine if i != q))[:n]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    return out


def test_neighbours_small(spark):
    rng = np.random.default_rng(0)
    data = [(k, rng.normal(size=8).round(3).tolist()) for k in range(90)]
    data += [(k, data[40][1]) for k in range(100, 130)]  # ties: equal vectors
    data += [(200, None), (201, [0.0] * 8), (220, [1.0, None] + [0.0] * 6), (240, [math.nan] + [1.0] * 7), (260, [math.inf] + [1.0] * 7)]
    data += [(None, [1.0] * 8), (300, [9.0] * 8)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = neighbours.search(table, lambda i: i % 20 == 0).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in found)
    assert got == sorted(x[:3] for x in nearest(data))
    nothing = table.where("vec_id = 200")
    assert neighbours.search(nothing, lambda i: i % 20 == 0).count() == 0
    assert neighbours.search(table.where("vec_id = 20"), lambda i: i % 20 == 0).count() == 0


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_NODES", 300)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    found = {(r.query_id, r.vec_id) for r in neighbours.search(table, lambda i: i % 20 == 0).collect()}
    wanted = {(q, i) for q, _, i, _ in nearest([tuple(r) for r in table.collect()])}
    assert len(found & wanted) >= 0.95 * len(wanted)


@pytest.mark.parametrize("factor", [1e4, 1e100])
def test_neighbours_with_long_vectors(spark, monkeypatch, factor):
    """A few vectors that are much longer spoil neither the graph nor the search."""
    monkeypatch.setattr(neighbours, "BLOCK_NODES", 300)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    vectors = centres[rng.integers(0, 40, 2400)] + 0.4 * rng.normal(size=(2400, 24))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[[7, 300, 1111, 2001, 2222]] *= factor
    vectors[2000] *= 30.0
    data = [(k, v.tolist()) for k, v in enumerate(vectors)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in neighbours.search(table, lambda i: i % 20 == 0).collect()}
    wanted = {(q, i) for q, _, i, _ in nearest(data)}
    print("recall", factor, len(found & wanted) / len(wanted))
    assert len(found & wanted) >= 0.97 * len(wanted)


# language


def test_language_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(table).withColumn("out", langid.held_out("doc_id")).where("out").select("lang", "lang_pred", "score", "rejected").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    assert sum(r.rejected for r in found) <= 0.02 * len(found)


def test_language_cases(spark):
    table = docs(spark)
    found = {r.doc_id: r for r in langid.identify(table).collect()}
    assert set(table.columns) <= set(langid.identify(table).columns)
    for k in (5, 6, 7, 9):
        assert (found[k].lang_pred, found[k].score, found[k].rejected) == ("und", 0.0, True)
    assert found[1].lang_pred in {"en", "de"}
    assert found[1]._same == "x"
    assert langid.identify(empty(spark)).count() == 0
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_held_out_is_crc32(spark):
    found = spark.range(50).select("id", langid.held_out("id").alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in found)


# quality


def test_quality_cases(spark):
    found = {r.doc_id: r for r in quality.quality(docs(spark)).collect()}
    data = {r[0]: r[1] for r in rows()}
    for i, text in data.items():
        w = words(text)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        places = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        got = found[i]
        assert (got.n_words, got.word_chars, got.n_repeat_words) == (len(w), sum(map(len, w)), len(places))
        assert got.n_dup_lines == len(lines) - len(set(lines))
        assert got.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert got.base_failed == (len(w) < 50 or 100 * len(places) > 50 * len(w))
        assert got.kept == (got.failed_rule is None)
    assert found[1].kept
    assert not found[11].kept
    assert found[1]._same == "x"
    assert quality.quality(empty(spark)).count() == 0


def test_rules_run_by_rejection_per_cost(spark):
    table = spark.range(100).withColumn("base_failed", F.lit(False))
    rules = [
        quality.Rule("never", F.lit(False), F.lit(1.0)),
        quality.Rule("dear", F.col("id") < 80, F.lit(100.0)),
        quality.Rule("cheap", F.col("id") < 10, F.lit(1.0)),
    ]
    assert quality.order_rules(table, rules) == ["cheap", "dear", "never"]


# mixing


def test_shortages_go_to_brothers_first(spark):
    """Leaf a/x is short; its brother a/y makes up for it, b does not change."""
    leaves = [("a", "x", 10), ("a", "y", 400), ("b", "z", 400)]
    table = spark.createDataFrame([(k, d, s, t) for k, (d, s, t) in enumerate(leaves)], "doc_id long, d string, s string, tokens long")
    found = {(r.d, r.s): r.budget for r in mixing.budgets(table, mixing.Mix(("d", "s"), share=0.4, max_epochs=1)).collect()}
    assert found[("a", "x")] == 10
    assert found[("a", "y")] == pytest.approx(0.4 * 810 / 2 - 10)
    assert found[("b", "z")] == pytest.approx(0.4 * 810 / 2)
    more = {(r.d, r.s): r.budget for r in mixing.budgets(table.where("s <> 'y'"), mixing.Mix(("d", "s"), share=0.9, max_epochs=1)).collect()}
    assert more == {("a", "x"): 10, ("b", "z"): pytest.approx(0.9 * 410 - 10)}


def test_mixing_cases(spark):
    mix = mixing.Mix(("lang", "source"), {"lang": {"en": 3, "de": 1}}, share=0.6, max_epochs=2)
    table = docs(spark)
    found = mixing.select(table, mix).collect()
    assert {r.doc_id for r in found}.isdisjoint({5, 6, 7})
    assert {r._same for r in found} == {"x"}
    total = sum(len(words(r[1])) for r in rows())
    assert 0 < sum(r.tokens for r in found) <= 0.6 * total
    assert mixing.select(empty(spark), mix).count() == 0
    again = mixing.select(table.repartition(5), mix).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    everything = mixing.select(table, mixing.Mix(("lang",), share=1.0, max_epochs=1))
    assert everything.count() == sum(1 for r in rows() if words(r[1]))


def test_epochs(spark):
    """More budget than tokens: whole epochs, then a prefix of the next in its own order."""
    table = spark.createDataFrame([(k, "a b c d", "x") for k in range(40)], "doc_id long, text string, source string")
    mix = mixing.Mix(("source",), share=2.5, max_epochs=3)
    found = mixing.select(table, mix).groupBy("doc_id").agg(F.max("epoch").alias("n")).collect()
    assert Counter(r.n for r in found) == {2: 20, 3: 20}


# archives


def pages(spark, data):
    return spark.createDataFrame([(*x, "s", "k") for x in data], "page_id long, url string, html string, _same string, _key string")


def test_archives_round_trip(spark):
    data = [(k, f"http://a/{k} b", f"<html>{prose(k, 80)}</html>") for k in range(120)]
    data += [(200, None, "same"), (201, "u", "same"), (202, "u", "same"), (203, "u", None), (204, "u", ""), (205, "u\nv", "ä€" * 90000)]
    data += [(206, "u", "again"), (206, "u", "again"), (None, "u", "same")]
    folder = scratch(spark, "warc-test")
    warc.write_archives(pages(spark, data).repartition(3), folder)
    found = warc.read_archives(spark, folder).collect()
    assert len(found) == len(data)
    bodies = defaultdict(list)
    for i, _, html in data:
        bodies[warc.digest((html or "").encode())].append(-1 if i is None else i)
    for r in found:
        assert r.refers_to == (None if r.page_id == max(bodies[r.payload_digest]) else max(bodies[r.payload_digest]))
        assert r.record_type == ("response" if r.refers_to is None else "revisit")
    payloads = {r.page_id: r for r in found if r.record_type == "response"}
    for i, _, html in data:
        if i in payloads:
            assert bytes(payloads[i].payload).decode() == (html or "")
            assert payloads[i].payload_bytes == len((html or "").encode())
    assert {r.payload_bytes for r in found if r.payload_digest == warc.digest(b"same")} == {4}
    files = spark.read.format("binaryFile").load(folder).where("path like '%part-%'").collect()
    assert all(bytes(f.content[:4]) == b"\x5d\x2a\x4d\x18" for f in files)


@pytest.mark.parametrize(("frames", "most"), [(7, 1 << 28), (10_000, 3000)])
def test_archives_end_and_begin_anew(spark, monkeypatch, frames, most):
    """A task writes several archives, by frames and by bytes, each with a trained dictionary in front."""
    monkeypatch.setattr(warc, "FRAMES", frames)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", most)
    data = [(k, f"http://a/{k}", f"<html>{prose(k, 60)}</html>") for k in range(90)]
    folder = scratch(spark, "warc-test")
    warc.write_archives(pages(spark, data).repartition(2), folder)
    files = spark.read.format("binaryFile").load(folder).where("path like '%part-%'").collect()
    assert len(files) > 4
    for f in files:
        size = int.from_bytes(f.content[4:8], "little")
        assert bytes(f.content[:4]) == b"\x5d\x2a\x4d\x18" and bytes(f.content[8:12]) == b"\x37\xa4\x30\xec"
        assert f.length <= size + most + 10_000 * 8 + 5000
    found = warc.read_archives(spark, folder).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in found} == {i: html for i, _, html in data}


def test_dictionary_is_trained_for_any_sample():
    one = warc.record(1, "u", b"hello", None, "2000-01-01T00:00:00Z")
    samples = [[], [one], [one] * 3, [warc.record(k, f"http://a/{k}", prose(k, 400).encode(), None, "") for k in range(300)]]
    for records in samples:
        found = warc.trained(records)
        assert found[:4] == b"\x37\xa4\x30\xec" and len(found) <= warc.DICTIONARY_BYTES
    assert len(warc.trained(samples[-1])) > 10_000


def test_archives_of_nothing(spark):
    assert warc.archived(pages(spark, [])).count() == 0
    assert warc.archived(pages(spark, [(1, None, None)])).select("payload_bytes").first()[0] == 0


def test_damaged_archive():
    whole = warc.record(1, "u", b"payload", None, "2000-01-01T00:00:00Z")
    assert warc.parse(whole)["payload"] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(whole.replace(b"payload\r", b"paxload\r"))


# packing


def test_tokenizers_agree():
    encode = packing.encoder(queries.tokenizer_path())
    letters = [chr(c) for c in [*range(1, 0x250), *range(0x2010, 0x2028), 0x20AC] if not packing.OTHER.search(chr(c))]
    texts = [f"a{c}b {c}c 1{c}2 {c}{c}\n{c}" for c in letters] + ["".join(letters), " \n\t x  y   z", "<|endoftext|> it's", ""]
    for text in texts:
        assert not packing.OTHER.search(text)
        assert encode(text).tolist() == encode.exact.encode(text, add_special_tokens=False).ids, repr(text)
    other = "日本語 \U0001d11e   done"
    assert packing.OTHER.search(other)
    assert encode(other).tolist() == encode.exact.encode(other, add_special_tokens=False).ids


def test_added_tokens(spark):
    """The ids are those of the file as it is: an added token's content is one id, wherever it stands."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(queries.tokenizer_path())
    encode = packing.encoder(queries.tokenizer_path())
    literal = "<|endoftext|>"
    texts = [f"a {literal} b", literal, f"{literal}{literal}x", f"日本{literal}", f"{prose(9, 900)} {literal}", "<|endoftext|", "a <|b|> c"]
    for text in texts:
        assert encode(text).tolist() == fresh.encode(text, add_special_tokens=False).ids, repr(text)
    assert encode(texts[0]).tolist() == [64, 220, 50256, 275]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.pieces(table, queries.tokenizer_path(), 256).collect())
    want = []
    for k, text in enumerate(texts):
        ids = np.array([*fresh.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want += [(k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for at, n in packing.cuts(len(ids), 256)]
    assert found == sorted(want)


def check_packed(found, texts, capacity):
    encode = packing.encoder(queries.tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, many in texts.items():
        want = []
        for text in many:
            ids = np.append(encode(text or ""), 0).astype("<u4")
            parts = packing.cuts(len(ids), capacity)
            want += [(k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(parts)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == sorted(want)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    total = sum(r.length for r in found)
    return len(by_sequence), -(-total // capacity)


def test_packing_cases(spark):
    texts = defaultdict(list)
    for r in rows():
        texts[r[0]].append(r[1])
    packed = packing.pack_documents(docs(spark), queries.tokenizer_path(), capacity=256, with_ids=True)
    check_packed(packed.collect(), texts, 256)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert packing.pack_documents(empty(spark), queries.tokenizer_path()).count() == 0


def test_packing_exchanges_between_groups(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    pieces = packing.pieces(table, queries.tokenizer_path())
    found = packing.pack(pieces, group_pieces=25).collect()
    used, least = check_packed(found, {r.doc_id: [r.text] for r in table.collect()}, 2048)
    assert used <= least + 2


def test_lower_bound_is_one():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.integers(1, 21, 9)
        bins = packing.best_fit(lengths, 20)[0].max() + 1
        assert packing.lower_bound(lengths, 20) <= optimum(sorted(lengths.tolist(), reverse=True), 20) <= bins
    assert packing.lower_bound(np.array([11, 11, 11, 9]), 20) == 3


def optimum(items, capacity, bins=()):
    if not items:
        return len(bins)
    best = math.inf
    for k in range(len(bins)):
        if bins[k] + items[0] <= capacity and bins[k] not in bins[:k]:
            best = min(best, optimum(items[1:], capacity, (*bins[:k], bins[k] + items[0], *bins[k + 1 :])))
    return min(best, optimum(items[1:], capacity, (*bins, items[0])))


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, FOLDER).collect()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    current = docs(spark).select(*names)
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, FOLDER)
        if name != "best_fit_packing":
            assert current.columns == names
    assert {r.doc_id for r in current.collect()} <= {r[0] for r in rows()}
    assert len({(r.doc_id, r.piece) for r in found}) == len(found)
    nothing = empty(spark).select(*names)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, FOLDER)
    assert nothing.count() == 0
