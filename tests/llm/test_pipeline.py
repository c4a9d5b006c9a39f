"""The pipeline's stages, each over what the one before kept, against brute force."""

import hashlib
from collections import defaultdict

import corpus_pipeline
from labtrail.llm import langid, packing
from labtrail.llm.queries import tokenizer_path
from tests.llm.common import FOLDER, words
from tests.llm.test_duplicates import classes_of, lines_left
from tests.llm.test_operators import check_packed

MIX = corpus_pipeline.MIX


def fill(capacity, weight, budget):
    """Budgets of children: each its weight's share, full ones give what is left to the others."""
    out, open_ = {}, set(capacity)
    while open_:
        total = sum(weight[k] for k in open_)
        full = {k for k in open_ if capacity[k] * total <= budget * weight[k]}
        if not full:
            return out | {k: budget * weight[k] / total for k in open_}
        for k in full:
            out[k] = capacity[k]
            budget -= capacity[k]
        open_ -= full
    return out


def mixed(rows):
    """Ids that the budgets take: rows (id, text, domain, lang, source)."""
    tokens = {r[0]: len(words(r[1])) for r in rows}
    path = {r[0]: tuple(x or "" for x in r[2:]) for r in rows}
    budgets = {(): MIX.share * sum(tokens.values())}
    for depth, level in enumerate(MIX.levels, 1):
        children = defaultdict(lambda: defaultdict(int))
        for i, p in path.items():
            children[p[: depth - 1]][p[:depth]] += tokens[i] * MIX.max_epochs
        for parent, capacity in children.items():
            weight = {k: MIX.weights.get(level, {}).get(k[-1], MIX.other) for k in capacity}
            budgets |= fill(dict(capacity), weight, budgets[parent])
    taken = set()
    leaves = defaultdict(list)
    for i, p in path.items():
        leaves[p].append(i)
    for p, ids in leaves.items():
        used = 0
        for i in sorted((x for x in ids if tokens[x]), key=lambda x: hashlib.md5(f"{MIX.seed}|1|{x}".encode()).hexdigest()):
            used += tokens[i]
            if used <= budgets[p] + 1e-6:
                taken.add(i)
    return taken


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "minhash_near_dedup", "mix_sources", "best_fit_packing"]

    judged = {r.doc_id: r for r in langid.identify(docs).collect()}
    known = stages["language_id"](spark, docs, FOLDER).cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert known.columns == names
    assert {r.doc_id: (r.lang, r.text) for r in known.collect()} == {i: (r.lang_pred, texts[i]) for i, r in judged.items() if not r.rejected}
    learned = {r.lang for r in docs.select("lang").distinct().collect()}
    assert {r.lang for r in known.collect()} <= learned

    lines = stages["line_dedup"](spark, known, FOLDER).cache()
    before = {r.doc_id: r.text for r in known.collect()}
    left = {i: t for i, t in lines_left(list(before.items())) if t == before[i] or words(t)}
    assert lines.columns == names
    assert {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {i: (t, None if t is None else len(t)) for i, t in left.items()}

    near = stages["minhash_near_dedup"](spark, lines, FOLDER).cache()
    data = list(left.items())
    groups = dict(zip([i for i, _ in data], classes_of(data), strict=True))
    assert near.columns == names
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(groups.values()))

    mix = stages["mix_sources"](spark, near, FOLDER).cache()
    rows = [(r.doc_id, r.text, r.domain, r.lang, r.source) for r in corpus_pipeline.with_domain(near).collect()]
    assert mix.columns == names
    assert {r.doc_id for r in mix.collect()} == mixed(rows)

    packed = stages["best_fit_packing"](spark, mix, FOLDER).collect()
    bins, least = check_packed(packed, {r.doc_id: [r.text] for r in mix.collect()}, 2048)
    assert bins <= least * 1.02 + 1


def test_stages_send_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(k, f"words of text {k} " * 40, "en", "web-00", 600) for k in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(name)
        try:
            stage(spark, docs, FOLDER)
            assert spark.conf.get(name) == corpus_pipeline.BATCH_BYTES
        finally:
            spark.conf.unset(name)


def test_slow_tokenizer_is_loaded_when_a_text_needs_it():
    encode = packing.Encoder(tokenizer_path())
    assert len(encode("plain text")) and "exact" not in vars(encode)
    assert len(encode("текст")) and "exact" in vars(encode)
