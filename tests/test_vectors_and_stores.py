"""Replicate vectors, bottom-k draws, lazy plans, the feature store and compiled ensembles against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labtrail.evaluation import bootstrap, metrics, replicates
from labtrail.functions.uniform import uniform, with_draw
from labtrail.models import boosting, compiled
from labtrail.models.compiled import Ensemble, Node
from labtrail.operators import feature_store, ranking
from labtrail.operators.feature_store import Source
from labtrail.sampling import recall


def scored_rows(spark, n=600):
    rng = random.Random(5)
    data = [(k, k % 3, rng.choice([0.5, rng.random(), None if k % 50 == 0 else 0.25]), rng.random(), int(rng.random() < 0.3)) for k in range(n)]
    return spark.createDataFrame(data, "person_id long, g int, a double, b double, y int")


def test_draws_in_numpy_equal_the_columns(spark):
    df = spark.range(50).select((F.col("id") * 7_000_000_123_456).alias("a"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("b"))
    wanted = {(r.a, r.b): r._draw for r in with_draw(df, "a", "b").collect()}
    numbers = np.array(sorted({a for a, _ in wanted}), dtype=np.int64)
    found = replicates.draws(numbers, np.arange(1, 21))
    assert all(found[i, b - 1] == wanted[int(a), b] for i, a in enumerate(numbers) for b in range(1, 21))


@pytest.mark.parametrize("method", ["exact", "poisson"])
def test_replicate_metrics_equal_those_of_drawn_rows(spark, method, monkeypatch):
    """Ties that are packed, small blocks and chunks, nulls: the same numbers as from the rows themselves."""
    monkeypatch.setattr(replicates, "MANY", 8)
    monkeypatch.setattr(replicates, "CHUNK", 50)
    df = scored_rows(spark)
    rows = replicates.weighed(df, ["g"], ["person_id"], 12, method)
    values = {"b": F.col("b")}
    found = replicates.replicate_metrics(rows, ["g"], {"a": F.col("a"), "b": F.col("b")}, "y", 12, values).collect()
    assert len(found) == 3 * 2 * 13
    drawn = bootstrap.resample(df, ["g"], ["person_id"], 12, ["a", "b", "y"], method)
    for which in ("a", "b"):
        wanted = {(r.g, r.replicate): r for r in metrics.ranked_metrics(drawn, ["g", "replicate"], which, "y").collect()}
        part = drawn.where(F.col(which).isNotNull() & (F.col("y") == 1)).groupBy("g", "replicate").agg(F.sum("b").alias("s"))
        sums = {(r.g, r.replicate): r.s for r in part.collect()}
        for r in (x for x in found if x.which == which):
            w = wanted[r.g, r.replicate]
            assert (r.n, r.n_case) == (w.n, w.n_case)
            assert (r.auc, r.avg_prec) == (pytest.approx(w.auc), pytest.approx(w.avg_prec))
            assert r.b_case == pytest.approx(sums[r.g, r.replicate])


def test_exploded_weights_are_the_draws(spark):
    df = scored_rows(spark, 100)
    rows = replicates.exploded(replicates.weighed(df, ["g"], ["person_id"], 9, "exact"), 9)
    got = sorted((r.person_id, r.replicate, r.weight) for r in rows.collect())
    drawn = bootstrap.resample(df, ["g"], ["person_id"], 9, ["person_id"], "exact")
    assert got == sorted((r.person_id, r.replicate, r["count"]) for r in drawn.groupBy("person_id", "replicate").count().collect())


def test_replicates_shuffle_rows_not_draws(spark):
    """The range exchange carries the rows of both scores, whatever the number of replicates."""
    df = spark.range(3000).select(F.col("id").alias("person_id"), F.rand(1).alias("a"), F.lit(1).alias("g"), (F.rand(2) < 0.2).cast("int").alias("y"))
    rows = replicates.weighed(df, ["g"], ["person_id"], 200, "poisson")
    found = replicates.replicate_metrics(rows, ["g"], {"": F.col("a")}, "y", 200)
    assert found.count() == 201
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" not in plan


def test_narrow_band_of_scores_is_spread(spark):
    df = spark.range(100_000).select((0.9995 + F.rand(3) * 0.0005).alias("s"), F.lit(1).alias("g"))
    for keys in ([], ["g"]):
        sizes = [r["count"] for r in ranking.with_cell(df, keys, "s").groupBy("_cell").count().collect()]
        assert len(sizes) == ranking.RANK_CELLS and max(sizes) < 3 * 100_000 / ranking.RANK_CELLS


def test_planned_equals_the_listed_plan(spark):
    bins = recall.Bins(0.0, (0.1, 0.2, 0.3, 0.4, 0.5))
    for capacity in ([100, 60, 30, 10, 7], [4, 4, 4, 4, 4], [11, 300, 300, 5, 9], [0, 0, 0, 0, 0]):
        rows = spark.createDataFrame([(g, c) for g, c in enumerate(capacity, 1) if c], "group int, capacity long")
        plan = sorted(tuple(r) for r in recall.planned(rows, bins, 90).collect())
        wanted = recall.sample_plan(90, capacity)
        assert plan == [(g, c, pytest.approx(float(n))) for g, (c, n) in enumerate(zip(capacity, wanted), 1)]


def test_bottom_k_draws(spark):
    """The first persons of every draw's order, from several tasks and batches."""
    df = spark.range(500).repartition(3).select(F.col("id").alias("person_id"), (F.col("id") % 2).cast("int").alias("group"), F.lit("Turku").alias("site"))
    found = recall.first_per_draw(df, ["group", "site"], 4, 10)
    by_cell = {}
    for r in found.collect():
        by_cell.setdefault((r.replicate, r.group), []).append((r._u, r.person_id))
    many = df.crossJoin(spark.range(1, 5).select(F.col("id").cast("int").alias("replicate")))
    many = many.withColumn("u", uniform("person_id", "replicate", salt="draw"))
    wanted = {}
    for r in many.collect():
        wanted.setdefault((r.replicate, r.group), []).append((r.u, r.person_id))
    for cell, rows in wanted.items():
        assert len(by_cell[cell]) <= 3 * 10
        assert [p for _, p in sorted(by_cell[cell])[:10]] == [p for _, p in sorted(rows)[:10]]


def test_young_persons_are_no_candidates(spark):
    persons = spark.createDataFrame([(1, "AURIA BIOBANK", "1950-01-01"), (2, "AURIA BIOBANK", "1990-01-01"), (3, "OTHER", "1950-01-01")], "person_id long, cohort string, birth_date string")
    persons = persons.withColumn("birth_date", F.to_date("birth_date"))
    rows = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)], "person_id long, split_set double")
    found = recall.candidates(rows, persons, F.to_date(F.lit("2000-01-01")))
    assert [r.person_id for r in found.collect()] == [1]


# -------------------------------------------------------------- feature store


def test_feature_store(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 0)], "person_id long, y int")
    wide = spark.createDataFrame([(1, 1.0, float("nan"), "x"), (2, 0.0, 5.0, "y"), (9, 7.0, 7.0, "z")], "person_id long, a double, b double, t string")
    codes = spark.createDataFrame([(1, "C1", 4), (2, "C1", 2), (2, "C2", 1), (9, "C2", 100)], "person_id long, feature string, value int")
    labs = spark.createDataFrame([(1, "L1_MEAN", 3.0), (1, "L2_MEAN", 4.0)], "person_id long, feature string, value double")
    sources = [Source("w", wide), Source("code", codes, absent=0.0, least=5), Source("lab", labs, leaking=["L2"])]
    _, catalog, vectors = feature_store.assembled(labels, sources, ["C1", "Z"])
    shown = [(r.place, r.group, r.feature, r.n_person, r.total, r.is_binary, r.absent) for r in catalog.orderBy("place").collect()]
    assert shown == [
        (0, "w", "a", 2, 1.0, True, None),
        (1, "w", "b", 1, 5.0, False, None),
        (2, "code", "C1", 2, 6.0, False, 0.0),  # C2 is rare among the labelled
        (3, "lab", "L1_MEAN", 1, 3.0, False, None),  # L2 restates the goal
        (4, "needed", "Z", 0, 0.0, True, 0.0),
    ]
    rows = sorted((r.person_id, r.y, r.places, r.vals) for r in vectors.collect())
    assert rows == [(1, 0, [0, 2, 3], [1.0, 4.0, 3.0]), (2, 1, [0, 1, 2], [0.0, 5.0, 2.0]), (3, 0, [], [])]
    named = feature_store.columns(labels, feature_store.store(labels, sources, ["a", "C1"]), {"a": None, "C1": 0.0}, ["Z"])
    got = {r.person_id: (r.a, r.C1, r.Z) for r in named.collect()}
    assert got == {1: (1.0, 4.0, 0.0), 2: (0.0, 2.0, 0.0), 3: (None, 0.0, 0.0)}


# ---------------------------------------------------------------- ensembles


def small_ensemble():
    deep = Node(0, 10, "a", 0.5, Node(0, 6, "b", 1.0, Node(1.0, 2), Node(0, 4, "a", 0.2, Node(-2.0, 1), Node(3.0, 3))), Node(0, 4, "c", 0.0, Node(5.0, 1), Node(-1.0, 3)))
    return Ensemble([(1.0, deep), (0.5, Node(0, 10, "b", 0.5, Node(2.0, 7), Node(-4.0, 3)))], logistic=False, start=0.25)


def expected(node, row, known):
    if node.feature is None:
        return node.value
    if node.feature in known:
        return expected(node.left if row[node.feature] <= node.threshold else node.right, row, known)
    return sum(x.rows / node.rows * expected(x, row, known) for x in (node.left, node.right))


def test_contributions_are_shapley_values():
    ensemble, names = small_ensemble(), ["a", "b", "c"]
    rng = np.random.default_rng(1)
    columns = {f: rng.normal(size=20) for f in names}
    found = compiled.explained(ensemble, columns)
    for k in range(20):
        row = {f: columns[f][k] for f in names}

        def value(known, row=row):
            return ensemble.start + sum(w * expected(t, row, known) for w, t in ensemble.trees)

        for f in names:
            others = [x for x in names if x != f]
            total = 0.0
            for size in range(len(others) + 1):
                for some in itertools.combinations(others, size):
                    chance = math.factorial(size) * math.factorial(2 - size) / math.factorial(3)
                    total += chance * (value({*some, f}) - value(set(some)))
            assert found[f][k] == pytest.approx(total)
        assert sum(found[f][k] for f in names) + ensemble.mean == pytest.approx(value(set(names)))


def test_exported_model_scores_like_the_model(spark):
    rng = random.Random(2)
    data = [(k, rng.random(), rng.random() if k % 5 else None, rng.randint(0, 3)) for k in range(300)]
    df = spark.createDataFrame(data, "person_id long, a double, b double, c int")
    df = df.withColumn("y", ((F.col("a") + F.coalesce("b", F.lit(0.9)) + F.col("c")) > 2.2).cast("int"))
    rows = boosting.assemble(df, ["a", "b", "c"], "y")
    for metric in ("logloss", "rmse"):
        fitted = boosting.fit_gbt(rows, metric, {"maxDepth": 3}, rounds=4, rate=0.3)
        ensemble = compiled.exported(fitted.models[1], ["a", "b", "c"])
        gaps = boosting.predict(fitted, rows).select(F.max(F.abs(F.col("abnorm_probs") - ensemble.score()))).first()[0]
        assert gaps < 1e-9


def test_quantile_fit(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, k % 4, (k % 4) * 10 + rng.gauss(0, 1 + k % 4)) for k in range(800)], "person_id long, a int, y double")
    rows = boosting.assemble(df, ["a"], "y")
    shares = {}
    for metric in ("q10", "q90"):
        fitted = boosting.fit_gbt(rows, metric, {"maxDepth": 2}, rounds=12, rate=0.5, features=["a"])
        below = boosting.predict(fitted, rows).groupBy("a").agg(F.avg((F.col("y") <= F.col("abnorm_probs")).cast("int")).alias("s"))
        shares[metric] = [r.s for r in below.collect()]
    assert all(0.03 < s < 0.25 for s in shares["q10"]) and all(0.75 < s < 0.97 for s in shares["q90"])
