"""Steps whose memory or time must not grow with what a row becomes, and queries over all labelled persons."""

import contextlib
import datetime
import io
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from labtrail.evaluation import bootstrap, compare, metrics, replicates
from labtrail.functions import dates
from labtrail.functions.uniform import uniform
from labtrail.operators import cohort, registry, series
from labtrail.plans import sampling
from labtrail.sources.driver_tables import Tables


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_grid_is_not_broadcast(spark):
    rows = spark.range(50).select(F.col("id").alias("person_id"), F.lit("m").alias("model"), F.lit(0.0).alias("split_set"), F.lit(1).alias("y"))
    members = rows.select("person_id", F.lit("All").alias("filter"))
    grid = compare.evaluation_grid(rows, members, compare.named_sets(), 0, ["model"])
    assert "Broadcast" not in plan(grid)
    assert grid.count() == 100


def test_persons_are_not_broadcast(spark, tmp_path):
    day = datetime.date(1950, 5, 4)
    customers = spark.createDataFrame([(k, k % 3) for k in range(9)] + [(None, 1), (4, 1)], "c_custkey long, c_nationkey int")
    orders = spark.createDataFrame([(k, k % 10, day, 40.0 + k, "F", "1-URGENT") for k in range(30)] + [(30, None, day, 1.0, "O", "5-LOW")],
                                   "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderstatus string, o_orderpriority string")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    aged = cohort.with_age(t.pred.select("person_id"), t.person, dates.day("1999-10-01"))
    for rows in (t.lab, aged):
        assert "Broadcast" not in plan(rows)
    # customer 4 is there twice, customer 9 is not, and an order without a customer has none
    assert t.lab.count() == 30
    assert aged.count() == 8 + 4 + 1


@pytest.fixture(scope="module")
def recall_tables(spark):
    """Persons of 20 and of 50 years at both sites, some of unknown age."""
    births = [datetime.date(1979, 1, 1), datetime.date(1949, 1, 1), None]
    cohorts = ["TAMPERE BIOBANK", "AURIA BIOBANK", "HELSINKI BIOBANK"]
    persons = [(i, births[i % 3], cohorts[i // 3 % 3]) for i in range(180)]
    preds = [(i, i % 2, i % 100 / 125, i % 90 / 113, float(i % 4)) for i in range(180)]
    return SimpleNamespace(
        spark=spark,
        person=spark.createDataFrame(persons, "person_id long, birth_date date, cohort string"),
        pred=spark.createDataFrame(preds, "person_id long, y int, p1 double, p2 double, split_set double"),
    )


def test_young_persons_are_labelled_and_binned(recall_tables):
    t = recall_tables
    labelled = [i for i in range(180) if i % 4 and i // 3 % 3 < 2]
    got = {r.person_id for r in sampling.site_label(t).collect()}
    assert got == set(labelled)
    first, second = [i for i in labelled if i % 100 / 125 <= 0.8], [i for i in labelled if i % 90 / 113 <= 0.8]
    assert {r.person_id for r in sampling.prob_bins(t).collect()} == set(first)
    assert {r.person_id for r in sampling.join_left_bins(t).collect()} == set(second)
    assert {r.person_id for r in sampling.join_multi_key(t).collect()} == set(first)
    for build in (sampling.lag_midpoint, sampling.bin_group_stats):
        assert sum(r.n for r in build(t).collect()) == len(first)
    assert sum(r.capacity for r in sampling.bin_capacity(t).where("kind = 'all'").collect()) == len(second)
    ages = {r.group: r.whisker_low for r in sampling.box_stats(t).where("variable = 'event_age'").collect()}
    assert set(ages.values()) == {20.0}
    # the last cut is the one at which the smaller site's count last changed
    assert sampling.bin_merge(t).count() > 0


def test_matrix_is_not_pivoted_and_keeps_all_rows(spark):
    counts = spark.createDataFrame(
        [(1, "A1", 2), (1, "A1", 3), (1, "zz", 9), (1, "C", None), (2, "zz", 1), (4, "C", 7), (4, None, 8), (None, "B", 4)],
        "person_id long, code string, n long",
    )
    persons = spark.createDataFrame([(1,), (1,), (3,), (4,), (None,)], "person_id long")
    wide = registry.code_matrix(counts, persons, "code", ["A1", "B", "C"])
    assert wide.columns == ["person_id", "A1", "B", "C"]
    assert "pivotfirst" not in plan(wide).lower()
    got = sorted((tuple(r) for r in wide.collect()), key=repr)
    assert got == sorted([(1, 5, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 7), (None, 0, 0, 0), (None, 0, 4, 0)], key=repr)


def test_filled_months_are_the_interpolated_calendar(spark):
    day = datetime.date
    rows = [
        (1, day(1998, 11, 1), 10.0, 40.0, "male"), (1, day(1999, 2, 1), None, 41.0, None), (1, day(1999, 5, 1), 16.0, None, "male"),
        (1, day(1999, 6, 1), 11.0, None, "male"), (2, day(1999, 1, 1), None, 30.0, "female"), (2, day(1999, 4, 1), 5.0, 31.0, "female"),
        (3, day(1999, 3, 1), 7.0, 50.0, "male"), (4, None, 7.0, 50.0, "male"), (None, day(1999, 1, 1), 2.0, 9.0, "male"), (None, day(1999, 3, 1), 3.0, 9.0, "male"),
    ]
    months = spark.createDataFrame(rows, "person_id long, dt date, value double, event_age double, sex string")
    every = months.join(series.month_calendar(months), ["person_id", "dt"], "right")
    wanted = series.carried(series.interpolate(every, ["value", "event_age"]), ["sex"]).select(*months.columns)
    found = series.filled_months(months, ["value", "event_age"], ["sex"])
    assert sorted(map(repr, found.select(*months.columns).collect())) == sorted(map(repr, wanted.collect()))
    text = plan(found).split("\n\n")[0]
    assert "Join" not in text and text.index("Generate") < text.index("Window")


def test_replicates_of_a_score_of_many_rows(spark):
    """A score of more rows than a step holds, in batches too small to be packed, next to other scores."""
    rows = spark.range(6000).select(
        F.col("id"), F.lit(1).alias("g"), (F.col("id") % 5 == 0).cast("int").alias("y"),
        F.when(F.col("id") % 10 < 8, 0.5).otherwise(F.round(uniform("id", salt="s"), 2)).alias("s"),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", replicates.MANY - 1)
    try:
        weighed = replicates.weighed(rows, ["g"], ["id"], 2, "exact")
        kept = weighed.select("id", "y", "s", "_drawn").toPandas()
        found = replicates.replicate_metrics(weighed, ["g"], {"": F.col("s")}, "y", 2).orderBy("replicate").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    weights = np.array([list(x) for x in kept["_drawn"]], dtype=float)
    assert (weights.sum(0) == 6000).all()
    score, case = kept["s"].to_numpy(), kept["y"].to_numpy() == 1
    for r in found:
        w = weights[:, r.replicate]
        wins = (score[case][:, None] > score[~case][None]) + 0.5 * (score[case][:, None] == score[~case][None])
        assert r.auc == pytest.approx((w[case] @ wins @ w[~case]) / (w[case].sum() * w[~case].sum()))


def test_draws_over_several_blocks_of_places(spark):
    size = 2 * (1 << 14) + 100
    rows = spark.range(size).select(F.col("id"), F.lit(1).alias("g"))
    weights = np.array([list(r[0]) for r in replicates.weighed(rows, ["g"], ["id"], 3, "exact").select("_drawn").collect()])
    assert weights.shape == (size, 4) and (weights.sum(0) == size).all()
    # a block's counts and what they are made from are some dozen MB, whatever the size of a group
    assert replicates.BLOCK * 101 * 8 < 16e6
    resampled = bootstrap.resample(rows, ["g"], ["id"], 3, ["id"]).where("replicate = 2").groupBy("id").count()
    assert resampled.where("count > 1").count() == int((weights[:, 2] > 1).sum())


def test_bin_computes_its_score_once(spark):
    rows = spark.range(100).select(uniform("id", salt="p").alias("p"), (F.col("id") % 2).alias("y"))
    frame = metrics.calibration_bins(rows, "p", "y", least=1)
    # once to filter, once for the bin, and once for the mean
    assert plan(frame).count("md5(") <= 4
    values = [r.p for r in rows.collect()]
    got = {r.bin: r.n for r in metrics.calibration_bins(rows, "p", "y", least=0).collect()}
    bins = [sum(i * 0.1 < v for i in range(11)) for v in values]
    assert got == {b: bins.count(b) for b in set(bins)}
