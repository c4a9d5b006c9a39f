"""Metrics and sampling against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labtrail.evaluation import bootstrap, compare, metrics
from labtrail.functions import special
from labtrail.operators import ranking
from labtrail.sampling import recall


def rows(n=400, seed=3, digits=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        out.append((i, y, round(rng.gauss(y, 1.5), digits), round(rng.gauss(y, 1.0), digits)))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    data = rows()
    return data, spark.createDataFrame(data, "person_id long, y int, a double, b double")


def brute_auc(y, s):
    pos = [v for t, v in zip(y, s) if t == 1]
    neg = [v for t, v in zip(y, s) if t == 0]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)


def brute_ap(y, s):
    total, out, last = sum(y), 0.0, 0.0
    for cut in sorted(set(s), reverse=True):
        hits = sum(t for t, v in zip(y, s) if v >= cut)
        n = sum(v >= cut for v in s)
        out += (hits / total - last) * hits / n
        last = hits / total
    return out


def test_ranked_metrics(scored):
    data, df = scored
    y, a = [r[1] for r in data], [r[2] for r in data]
    got = metrics.ranked_metrics(df, [], "a", "y").first()
    assert got.auc == pytest.approx(brute_auc(y, a))
    assert got.avg_prec == pytest.approx(brute_ap(y, a))
    flipped = metrics.ranked_metrics(df.withColumn("a", -F.col("a")), [], "a", "y").first()
    assert flipped.auc == pytest.approx(1 - got.auc)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, a double")
    assert metrics.ranked_metrics(df, [], "a", "y").first().auc is None


def test_delong(scored):
    data, df = scored
    y = np.array([r[1] for r in data])
    v10, v01 = [], []
    for col in (2, 3):
        s = np.array([r[col] for r in data])
        psi = (s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :])
        v10.append(psi.mean(axis=1))
        v01.append(psi.mean(axis=0))
    var = np.cov(v10) / (y == 1).sum() + np.cov(v01) / (y == 0).sum()
    se = math.sqrt(var[0, 0] + var[1, 1] - 2 * var[0, 1])
    got = compare.with_delong_p(compare.delong(df, [], "a", "b", "y")).first()
    assert got.se_diff == pytest.approx(se)
    assert got.p == pytest.approx(math.erfc(got.z / math.sqrt(2)))
    same = compare.delong(df.withColumn("c", F.col("a")), [], "a", "c", "y").first()
    assert same.auc_1 == same.auc_2 and same.z is None


def test_reclassification_and_resample_size(scored):
    data, df = scored
    y = np.array([r[1] for r in data])
    d = np.sign(np.array([r[3] - r[2] for r in data]))
    got = metrics.nri(df, [], "a", "b", "y").first().nri
    assert got == pytest.approx(d[y == 1].mean() - d[y == 0].mean())
    drawn = bootstrap.resample(df.withColumn("g", F.lit(1)), ["g"], ["person_id"], 5, ["y", "a", "b"])
    assert {r["count"] for r in drawn.groupBy("replicate").count().collect()} == {len(data)}
    pair = bootstrap.paired_metrics(df.withColumn("g", F.lit(1)), ["g"], "a", "b", "y").first()
    assert pair.nri == pytest.approx(got)


def test_quantiles_and_negative_scores(spark):
    values = [-5.5, -5.5, -1e-9, 0.0, 0.0, 1e-7, 2.25, 3.0, 1e6]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    points = {f"p{int(q * 100)}": q for q in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)}
    got = ranking.quantiles(df, [], "v", points).first()
    for name, q in points.items():
        assert got[name] == pytest.approx(float(np.quantile(values, q)))
    near = ranking.quantiles(df, [], "v", {"q": 0.25}, "nearest").first().q
    assert near == sorted(values)[math.floor(8 * 0.25 + 0.5)]


def test_random_position_is_a_permutation(spark):
    df = spark.range(5000).select(F.col("id").alias("person_id"), (F.col("id") % 2).alias("g"))
    placed = ranking.random_position(df, ["g"], ["person_id"], "x")
    for g in (0, 1):
        assert sorted(r.pos for r in placed.where(F.col("g") == g).collect()) == list(range(2500))


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 0), (1.0, 1), (0.95, 1)], "p double, y int")
    got = {r.bin: r.n for r in metrics.calibration_bins(df, "p", "y", least=0).collect()}
    # zero lies outside every bin, an upper edge belongs to its bin
    assert got == {1: 1, 10: 2}


def test_special_functions():
    assert special.log10_two_sided(1.959963984540054) == pytest.approx(math.log10(0.05))
    assert special.log10_two_sided(40) == pytest.approx(-349.1355, abs=1e-3)
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, rel=1e-6)
    assert special.beta_cdf(0.3, 2, 5) == pytest.approx(0.579825)
    assert special.beta_cdf(special.beta_quantile(0.975, 0.1, 7.1), 0.1, 7.1) == pytest.approx(0.975)


def test_sample_plan_stays_within_capacity():
    for capacity in ([100, 60, 30, 10], [4, 4, 4], [500], [0, 100, 7], [11, 300, 300, 5, 9]):
        plan = recall.sample_plan(90, capacity)
        assert all(n <= 2 * round(c / 2) for n, c in zip(plan, capacity))
        assert sum(plan) <= 90 + len(capacity) * 2


def test_plan_collapse():
    sizes = {1: 2.0, 2: 3.0, 3: 5.0, 4: 7.0}
    assert recall.plan_collapse((0.2, 0.5), (0.1, 0.2, 0.3, 0.5), sizes, 0.01) == {1: 5.0, 2: 12.0}


def test_bin_merge_against_repeated_counting(spark):
    rng = random.Random(7)
    data = [(i, rng.random() ** 3, rng.choice(["Tampere", "Turku"])) for i in range(300)]
    df = spark.createDataFrame(data, "person_id long, prob double, site string")
    bins = recall.Bins(0.005, tuple(round(0.05 * k, 2) for k in range(1, 20)))
    merged = recall.bin_merge(df, bins)
    bounds = [-1.0, *merged.cuts]
    for low, high in zip(bounds[:-2], bounds[1:-1]):
        for site in ("Tampere", "Turku"):
            assert sum(s == site and low <= p < high for _, p, s in data) >= 10


def test_draws_never_exceed_plan_or_capacity(spark):
    data = [(i, i % 4 / 10 + 0.01, ["Tampere", "Turku"][i % 2], i % 3 == 0) for i in range(120)]
    df = spark.createDataFrame(data, "person_id long, prob double, site string, y boolean")
    bins = recall.Bins(0.0, (0.1, 0.2, 0.3, 0.4))
    binned = recall.prob_bins(df, bins)
    drawn = recall.stratified_draw(binned, {1: 10.0, 2: 200.0, 3: 4.0, 4: 0.0})
    counts = {(r.group, r.site): r["count"] for r in drawn.groupBy("group", "site").count().collect()}
    assert counts == {(1, "Tampere"): 5, (2, "Turku"): 30, (3, "Tampere"): 2}


def test_integer_mix_is_uniform(spark):
    from labtrail.functions.uniform import DRAW_BITS, with_draw

    df = spark.range(200).select(F.col("id").alias("a")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(500))))
    u = with_draw(df, "a", "b").withColumn("u", F.col("_draw") / F.lit(float(1 << DRAW_BITS))).toPandas()
    assert u.u.between(0, 1, inclusive="left").all()
    counts = np.histogram(u.u, bins=50, range=(0, 1))[0]
    assert ((counts - 2000) ** 2 / 2000).sum() < 90  # 49 degrees of freedom
    grid = u.pivot(index="b", columns="a", values="u").to_numpy()
    assert abs(np.corrcoef(grid[:-1].ravel(), grid[1:].ravel())[0, 1]) < 0.02
    assert abs(np.corrcoef(grid[:, :-1].ravel(), grid[:, 1:].ravel())[0, 1]) < 0.02
    distinct = [len(set(np.floor(row * 200))) / 200 for row in grid]
    assert abs(np.mean(distinct) - (1 - math.exp(-1))) < 0.01


def test_poisson_weights(spark):
    """Replicates have about n rows each, rows about one copy; replicate 0 is the data."""
    from labtrail.evaluation.bootstrap import resample

    df = spark.range(400).select(F.col("id").alias("person_id"), (F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    drawn = resample(df, ["g"], ["person_id"], 60, ["v"], method="poisson").toPandas()
    assert sorted(drawn[drawn.replicate == 0].v) == list(range(400))
    sizes = drawn[drawn.replicate > 0].groupby("replicate").size()
    assert abs(sizes.mean() - 400) < 10
    assert 10 < sizes.std() < 30
    counts = drawn[drawn.replicate > 0].groupby(["replicate", "v"]).size()
    zero = 1 - len(counts) / (60 * 400)
    assert abs(zero - math.exp(-1)) < 0.02
