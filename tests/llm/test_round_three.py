"""Infill, Merkle manifest and vector dedup against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labtrail.llm import infill, merkle, queries, vector_dedup
from tests.llm.common import FOLDER, docs, empty, rows


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -------------------------------------------------------------------- infill


def infilled(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'null' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
    form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return n, form, None if plain else a, None if plain else b - a, out, text


def check_infill(frame):
    made = infill.transformed(frame)
    made = made.withColumn("back", infill.restored(F.col("output"), F.col("form")))
    for r in made.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) == infilled(r.doc_id, r.text)


def test_infill_cases(spark):
    odd = ["é😀\r\nab" * 50_000, "a" * infill.BLOCK, "b" * (2 * infill.BLOCK + 1), "x<P>y", "<S>", "q<M>", "<P", "$1\\E", "\r\n \u0085" * 9]
    found = rows() + [(100 + k, t, "en", "s", 0, "x", "y", "z", "w", "v") for k, t in enumerate(odd * 4)]
    check_infill(docs(spark, found))
    check_infill(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert infill.transformed(empty(spark)).count() == 0


def test_infill_keeps_rows_and_replaces_names(spark):
    frame = docs(spark).withColumn("n", F.lit("old")).withColumn("output", F.lit(1))
    made = infill.transformed(frame)
    assert sorted(made.columns) == sorted({*frame.columns, "n", "form", "prefix_chars", "middle_chars", "output"})
    assert made.count() == len(rows())
    assert "Python" not in made._jdf.queryExecution().toString()


def test_infill_by_words_and_other_markers(spark):
    config = infill.Infill(rate=100, spm=50, unit=r"\S+\s*", prefix="[$1]", suffix="(*)", middle="\\m")
    frame = spark.createDataFrame([(k, "one two  three four\nfive " * (k % 7 + 1)) for k in range(40)], "doc_id long, text string")
    made = infill.transformed(frame, config).withColumn("back", infill.restored(F.col("output"), F.col("form"), config)).collect()
    assert {r.form for r in made} == {"psm", "spm"}
    for r in made:
        assert r.n == len(r.text.split()) and r.back == r.text
        start = r.output.index("[$1]") + 4
        prefix = r.output[start : r.output.index("(*)" if r.form == "psm" else "\\m", start)]
        assert len(prefix.split()) == r.prefix_chars


# -------------------------------------------------------------------- merkle


def tree(leaves, arity=3):
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i : i + arity])) for i in range(0, len(low), arity)])
    return levels


def way(levels, i, arity=3):
    found = []
    for level in levels[:-1]:
        run = i // arity * arity
        found.append(("".join(level[run:i]), "".join(level[i + 1 : run + arity])))
        i //= arity
    return found


def manifest(table, arity=3):
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = {}
    for row in table:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]], arity) for g in order}
    top = tree([trees[g][-1][0] for g in order], arity)
    found = []
    for k, g in enumerate(order):
        for i, row in enumerate(groups[g]):
            path = way(trees[g], i, arity) + way(top, k, arity)
            seen = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                seen = (*row[:4], row[4].replace("\n", ""))
            node = leaf(seen)
            for left, right in path:
                node = sha(left + node + right)
            root = top[-1][0]
            proof = sha("".join(a + b for a, b in path))
            found.append((row[0], leaf(row), trees[g][-1][0], root, proof, node, node == root))
    return sorted(found, key=repr)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def built(frame, **settings):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = frame.select(
        F.col("source").alias("group"), F.col("doc_id").alias("key"), merkle.leaf(*FIELDS).alias("leaf"), merkle.leaf(*FIELDS[:4], text).alias("seen")
    )
    found = merkle.proofs(merkle.build(leaves, "group", ["key"], carried=["seen"], **settings))
    root = merkle.folded(F.col("c_seen"), F.col("path"))
    out = found.select("c_key", "node", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))), root, root == F.col("root"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize(("arity", "every"), [(3, 4), (3, 1), (2, 3)])
def test_manifest_cases(spark, arity, every):
    """Nulls, repeated rows and keys, one-row groups, a hot group of many levels."""
    random.seed(1)
    table = [
        (i if i % 37 else None, random.choice([None, "", "a", "é"]) if i < 60 else "hot", "en" if i % 3 else None, i, random.choice(["a\nb", None, "", "x\n"]))
        for i in range(400)
    ]
    table += [table[70]] * 7 + [(5, "alone", None, None, "text")]
    frame = spark.createDataFrame(table, "doc_id long, source string, lang string, n_chars int, text string")
    assert built(frame, arity=arity, every=every) == manifest(table, arity)


def test_manifest_of_cases_table(spark):
    frame = docs(spark)
    assert built(frame) == manifest([tuple(r) for r in frame.select(*FIELDS).collect()])
    assert built(empty(spark)) == []
    assert built(frame.limit(1))[0][-1] in (True, False)


def test_manifest_query(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*FIELDS)
    got = queries.op11_merkle_manifest(spark, FOLDER)
    got = got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=repr) == manifest([tuple(r) for r in frame.collect()])


# ------------------------------------------------------------------- vectors


def linked(data):
    """(id, links, smallest id of the component, kept) by all pairs."""
    ids, width = [i for i, _ in data], max((len(v) for _, v in data if v), default=1)
    x, ok = np.zeros((len(data), width)), np.zeros(len(data), bool)
    for k, (i, v) in enumerate(data):
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x[k, : len(v)], ok[k] = v, True
    x /= np.where(ok, np.linalg.norm(x, axis=1), 1)[:, None]
    near = (x @ x.T >= 0.95) & ok[None] & ok[:, None]
    np.fill_diagonal(near, False)
    label = list(range(len(data)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in zip(*np.nonzero(near), strict=True):
        label[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    out = [(i, int(near[k].sum()), None if i is None else least[find(k)], i is None or least[find(k)] == i) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 16))
    data = [(k, v.tolist()) for k, v in enumerate(base)]
    data += [(1000 + k, base[0].tolist()) for k in range(80)]  # copies
    data += [(2000 + k, (base[1] + 0.1 * rng.normal(size=16)).tolist()) for k in range(120)]  # near copies
    data += [(3000 + k, (base[2 + k] * 3).tolist()) for k in range(5)]  # other lengths
    nan, inf = float("nan"), float("inf")
    data += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [nan] * 16), (4004, [1.0, None] + [0.0] * 14), (4005, [inf] + [0.0] * 15)]
    data += [(4006, [1.0, 2.0]), (4007, [2.0, 4.0]), (None, base[0].tolist()), (4008, [1e30] * 16), (4009, [1e-30] * 16), (5, base[5].tolist())]
    return data


def check_vectors(frame):
    data = [(r.vec_id, r.embedding) for r in frame.select("vec_id", "embedding").collect()]
    found = vector_dedup.classes(frame).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in found), key=repr) == linked(data)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_cases(spark, kind):
    frame = spark.createDataFrame(vectors(), f"vec_id long, embedding array<{kind}>")
    check_vectors(frame.withColumn("node", F.lit("x")).withColumn("code", F.lit(None)).withColumn("n_links", F.lit(1)))


def test_vector_lists_and_groups(spark, monkeypatch):
    """Many lists, and lists that are cut into several groups of members and of queries."""
    for name, value in (("LIST", 24), ("MEMBERS", 30), ("QUERIES", 40)):
        monkeypatch.setattr(vector_dedup, name, value)
    check_vectors(spark.createDataFrame(vectors(), "vec_id long, embedding array<double>"))


def test_vector_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_dedup.classes(frame).count() == 0
    check_vectors(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>"))


def test_vector_query(spark):
    frame = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    found = queries.op12_vector_dedup(spark, FOLDER).collect()
    assert sorted((tuple(r) for r in found), key=repr) == linked([(r.vec_id, r.embedding) for r in frame.collect()])


def test_vector_recall_at_the_limit(spark):
    """Pairs exactly at the limit, in random directions, across many lists."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * away
    data = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    links = sum(r.n_links for r in vector_dedup.classes(frame).collect())
    assert links >= 0.99 * 6000
