"""Near duplicates and repeated lines against brute force."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np

from labtrail.llm import line_dedup, minhash, queries, spans
from labtrail.llm import components as components_module
from labtrail.llm.components import components, linked
from tests.llm.common import FOLDER, docs, empty, prose, rows, words


def weighted_sets(texts):
    shingles = []
    for text in texts:
        w = words((text or "").lower())
        k = min(5, len(w))
        shingles.append(Counter(" ".join(w[j : j + k]) for j in range(len(w) - k + 1)) if w else Counter())
    seen = Counter(s for x in shingles for s in x)
    n = len(texts)
    weight = {s: 0.8 + 0.2 * min(1.0, max(0.0, math.log(n / c) / math.log(1000))) for s, c in seen.items() if c > n / 1000}
    return [{s: c * weight.get(s, 1.0) for s, c in x.items()} for x in shingles]


def classes_of(data):
    """Classes by all pairs: rows (id, text) -> list of class ids."""
    sets = weighted_sets([t for _, t in data])
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if not x or not y:
                continue
            shared = sum(min(v, y[s]) for s, v in x.items() if s in y)
            if shared / (sum(x.values()) + sum(y.values()) - shared) >= 0.8:
                parent[find(a)] = find(b)
    big = 1 << 62
    least = defaultdict(lambda: big)
    for k, (i, _) in enumerate(data):
        least[find(k)] = min(least[find(k)], big if i is None else i)
    return [None if least[find(k)] == big else least[find(k)] for k in range(len(data))]


def check(spark, data):
    table = spark.createDataFrame(data, "doc_id long, text string")
    found = sorted(((r.doc_id, r.class_id) for r in minhash.classes(table).collect()), key=repr)
    assert found == sorted(zip([i for i, _ in data], classes_of(data), strict=True), key=repr)


def test_near_cases(spark):
    check(spark, [r[:2] for r in rows()])


def test_near_table(spark):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()])


def test_near_large_group(spark):
    """A third of all rows are copies with one word changed each."""
    base = prose(50, 120).split()
    data = [(k, " ".join(base[:k] + [f"other{k}"] + base[k + 1 :])) for k in range(60)]
    data += [(1000 + k, prose(k + 500, 100)) for k in range(120)]
    check(spark, data)


def test_leader_links(spark):
    """Links are true ones and connect the classes; a hot group has links to leaders, not all of its links."""
    base = prose(50, 120).split()
    data = [(k, " ".join(base[:k] + [f"other{k}"] + base[k + 1 :])) for k in range(30)]
    data += [(1000 + k, prose(k + 500, 100)) for k in range(20)]
    sets = weighted_sets([t for _, t in data])
    near = Counter()
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            shared = sum(min(v, y[s]) for s, v in x.items() if s in y)
            near[data[a][0]] += a != b and shared / (sum(x.values()) + sum(y.values()) - shared) >= 0.8
    found = minhash.classes(spark.createDataFrame(data, "doc_id long, text string"))
    assert "n_links" not in found.columns
    assert queries.QUERIES["op9_minhash_near_dedup"](spark, FOLDER).columns == ["doc_id", "class_id", "n_leader_links", "copies"]
    links = {r.doc_id: r.n_leader_links for r in found.collect()}
    assert all((links[i] > 0) == (near[i] > 0) and links[i] <= near[i] for i, _ in data)
    assert sum(links.values()) < sum(near.values())


def test_representatives(spark):
    kept = minhash.representatives(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    # 2 copies 1; 4 and the row without id are near 3; one of the equal rows 10 stays
    assert [i for _, i in ids] == [1, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13]
    assert minhash.representatives(empty(spark)).count() == 0


def test_signature_agreement():
    """Samples agree about as often as the sets are alike."""
    rng = np.random.default_rng(4)
    agree, expected = [], []
    for _ in range(60):
        shared = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        one = np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 10, dtype=np.uint64)]))
        two = np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 10, dtype=np.uint64)]))
        a = (one, np.where(one % np.uint64(3) == 0, 2.0, 0.85))
        b = (two, np.where(two % np.uint64(3) == 0, 2.0, 0.85))
        agree.append(np.mean(minhash.signature(*a) == minhash.signature(*b)))
        expected.append(minhash.similarity(a, b) ** minhash.ROWS)
    assert abs(np.mean(agree) - np.mean(expected)) < 0.06


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 7), (200, 201), (202, 201)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(31)} | {100: 0, 200: 200, 201: 200, 202: 200}


def test_links_connect_a_bucket(spark):
    """Numbers on a line, linked when two apart or less: one bucket, leaders in rounds."""
    values = [0, 1, 3, 4, 10, 11, 20, 22, 24, 26, 50]
    members = spark.createDataFrame([(1, v, v) for v in values], "bucket long, node long, order long")
    measure = lambda pairs: pairs.selectExpr("a", "b", "least(abs(a - b), 5.0D) as distance")
    for rounds in (1, 2, 4):
        links = linked(members, measure, 2.0, "abs(x.node - y.node) <= 2", rounds)
        found = {r.node: r.label for r in components(links).collect()}
        assert found == {0: 0, 1: 0, 3: 0, 4: 0, 10: 10, 11: 10, 20: 20, 22: 20, 24: 20, 26: 20}, rounds


def tasks_of(spark, name, work):
    """What `work` returns, and the number of tasks that its jobs have run."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(name) if (job := status.getJobInfo(j)) for s in job.stageIds}
    return out, sum(i.numCompletedTasks for s in stages if (i := status.getStageInfo(s)))


def test_small_tables_of_links_take_few_tasks(spark, monkeypatch):
    """Few links and members, many shuffle partitions: the tasks follow the rows. Many partitions give the same."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    links = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 10 != 9], "a long, b long")
    members = spark.createDataFrame([(k // 30, k, k) for k in range(300) if k % 10 != 9], "bucket long, node long, `order` long")
    texts = spark.createDataFrame([(k, f"{'x' * 30}{k // 10:03}{'y' * 40}") for k in range(300)], "node long, line string")
    tiles = components_module.Tiles(texts.withColumnRenamed("line", "text"), line_dedup.tile_links(2))

    def joined():
        found = linked(members, line_dedup.measured(texts, 2), 2.0, tiles)
        return {(r.a, r.b) for r in found.collect()}, {r.node: r.label for r in components(links).collect()}

    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        (pairs, labels), tasks = tasks_of(spark, "small-links", joined)
        assert tasks < 50 * 40
        assert labels == {k: k // 10 * 10 for k in range(300)}
        # lines of one bucket are within two edits
        classes = {r.node: r.label for r in components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
        assert classes == {k: k // 30 * 30 for k in range(300) if k % 10 != 9}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        monkeypatch.setattr(components_module, "NARROW", 64)
        assert joined() == (pairs, labels)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def edits(a, b):
    return line_dedup._plain_distance(a, b)


def test_edit_distance():
    rng = random.Random(3)
    pairs = [("", ""), ("a", ""), ("", "abc"), ("ä€𝄞" * 9, "ä€x" * 9)]
    for _ in range(500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            b.insert(rng.randint(0, len(b)), rng.choice("abc"))
            b.pop(rng.randrange(len(b)))
        pairs.append((a, "".join(b)))
    for most in (2, 4):
        assert line_dedup.edit_distances(pairs, most).tolist() == [min(edits(a, b), most + 1) for a, b in pairs]


def lines_left(data):
    """rows (id, text) -> sorted (id, text left), by all pairs of different lines."""
    big = 1 << 62
    places = defaultdict(list)
    for i, t in {(big if i is None else i, t) for i, t in data if t is not None}:
        for k, line in enumerate(t.split("\n")):
            if words(line):
                places[line].append((i, _same(t), k))
    label = {x: x for x in places}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    long = [x for x in places if len(x) >= line_dedup.MIN_CHARS]
    for n, a in enumerate(long):
        for b in long[:n]:
            if abs(len(a) - len(b)) <= line_dedup.EDITS and line_dedup.edit_distances([(a, b)], 2)[0] <= line_dedup.EDITS:
                label[find(a)] = find(b)
    first = {}
    for x, at in places.items():
        first[find(x)] = min(first.get(find(x), (big + 1,)), min(at))
    out = []
    for i, t in data:
        if t is None:
            out.append((i, None))
            continue
        me = big if i is None else i
        left = [x for k, x in enumerate(t.split("\n")) if not words(x) or first[find(x)] == (me, _same(t), k)]
        out.append((i, "\n".join(left)))
    return sorted(out, key=repr)


def _same(text):
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def test_lines(spark):
    base = prose(70, 12).replace("\n", " ")
    extra = [
        (30, f"{base}\n\n{base[:-1]}x\nshort\nshort\n"),
        (31, f"{base[:5]}{base[7:]}\nshort\n{base}ab\n{base}abc"),
        (32, base[::-1]),
    ]
    data = [r[:2] for r in rows()] + extra
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    found = sorted(((r.doc_id, r.text) for r in line_dedup.dedup(table).collect()), key=repr)
    assert found == lines_left(data)


def test_lines_table(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    data = [tuple(r) for r in table.collect()]
    found = sorted(((r.doc_id, r.text) for r in line_dedup.dedup(table).collect()), key=repr)
    assert found == lines_left(data)


def test_lines_keep_columns(spark):
    kept = line_dedup.dedup(docs(spark))
    assert set(docs(spark).columns) <= set(kept.columns)
    assert {r._same for r in kept.collect()} == {"x"}
    assert line_dedup.dedup(empty(spark)).count() == 0


def test_tiles_connect_what_pairs_connect(spark, monkeypatch):
    """Many small buckets that share groups, and one that is cut into tiles: the classes of all pairs."""
    from labtrail.llm import components as module
    from labtrail.llm.components import Tiles

    rng = random.Random(6)
    base = "the quick brown fox jumps over the lazy dog and runs away"
    lines = {k: "".join(c if rng.random() > 0.03 else rng.choice("xyz") for c in base) for k in range(60)}
    for k in range(60, 90):
        lines[k] = prose(k, 9)[:40].replace("\n", " ").ljust(40, "q")
        lines[k + 100] = lines[k][:20] + "#" + lines[k][20:]
    members = [(7, k) for k in range(60)] + [(1000 + k, k + d) for k in range(60, 90) for d in (0, 100)]
    frame = spark.createDataFrame(members, "bucket long, node long")
    texts = spark.createDataFrame(list(lines.items()), "node long, text string")
    parent = {k: k for k in lines}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for bucket in {b for b, _ in members}:
        inside = [n for b, n in members if b == bucket]
        for a in inside:
            for b in inside:
                if a < b and edits(lines[a], lines[b]) <= 2:
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    wanted = {k: find(k) for k in lines if any(find(k) == find(x) for x in lines if x != k)}
    for size in (512, 16):
        monkeypatch.setattr(module, "TILE", size)
        found = Tiles(texts, line_dedup.tile_links(2)).links(frame, frame)
        labels = {r.node: r.label for r in components(found).collect()}
        assert labels == wanted, size


def test_a_text_travels_once_to_its_lines(spark):
    table = spark.createDataFrame([(1, "a line that is long enough to be compared\nb"), (2, "a line that is long enough to be compared\nc"), (3, None), (None, "")], "doc_id long, text string")
    kept = line_dedup.dedup(table)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join LeftOuter", 1)
    assert "split(" in above and "split(" not in below
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in kept.collect()}
    assert found == {1: ("a line that is long enough to be compared\nb", 2, 0), 2: ("c", 2, 1), 3: (None, 0, 0), None: ("", 1, 0)}


def test_lines_are_filed_in_slices_of_bounded_size():
    assert list(spans.chunks([5, 5, 1, 20, 1], 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert line_dedup.FILED <= spans.CHUNK // 2


def test_signatures_are_made_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list("abcdefgh é"), rng.integers(30, 90))) for _ in range(300)] + ["x" * 900]
    whole = {(int(p), int(r)) for p, r in zip(*line_dedup.signatures(lines), strict=True)}
    monkeypatch.setattr(line_dedup, "PRINTED", 500)
    assert {(int(p), int(r)) for p, r in zip(*line_dedup.signatures(lines), strict=True)} == whole
    assert [len(x) for x in line_dedup.signatures([])] == [0, 0]


def test_memory_of_signatures_is_bounded_by_a_piece():
    lines = [f"{k:07d}" * 20_000 for k in range(14)]  # 2 million characters, few fingerprints
    line_dedup.signatures(lines[:1])
    tracemalloc.start()
    line_dedup.signatures(lines)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000
