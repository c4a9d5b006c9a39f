"""Hot keys, plan shapes and whole results."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from labtrail.evaluation import metrics
from labtrail.operators import cleaning, cohort, ranking, registry, series
from labtrail.plans import catalog
from labtrail.plans.cleaning import RULES
from labtrail.sampling import recall
from labtrail.sources.driver_tables import Tables
from labtrail.sources.readers import select_code

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows belongs to one person, many of them copies of one row."""
    n = F.col("id")
    hot = n % 3 == 0
    return spark.range(30000).select(
        n.alias("rid"),
        F.when(hot, -1).otherwise(n % 500).alias("person_id"),
        F.lit("male").alias("sex"),
        F.lit(50).alias("event_age"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.floor(n / 7) % 700).cast("int")).alias("dt"),
        F.when(n % 2 == 0, 100.0).otherwise(80.0 + n % 40).alias("value"),
        F.lit("umol/l").alias("unit"),
        F.lit("N").alias("flag"),
    )


def test_daily_series_bounds_a_hot_person(skewed):
    daily = cleaning.daily_last(skewed)
    per = daily.groupBy("person_id").count()
    assert per.agg(F.max("count")).first()[0] <= 700
    expected = skewed.select("person_id", "dt").distinct().count()
    assert daily.count() == expected


def test_copies_are_combined_before_the_exchange(skewed):
    text = plan(cleaning.dedup_exact(skewed))
    first = text.index("Exchange")
    # the lower aggregate runs before the rows are exchanged
    assert text.count("Aggregate", 0, text.index("(1)")) >= 2 and first > 0
    kept = cleaning.dedup_exact(skewed).count()
    assert kept == skewed.select("person_id", "dt", "value", "unit").distinct().count()


def test_ranked_metric_of_one_hot_score(skewed):
    df = skewed.select((F.col("rid") % 5 == 0).cast("int").alias("y"), F.when(F.col("rid") % 3 == 0, 0.5).otherwise(F.col("rid") / 30000).alias("s"))
    pdf = df.toPandas()
    ranks = pdf.s.rank()
    m, n = pdf.y.sum(), (1 - pdf.y).sum()
    wanted = (ranks[pdf.y == 1].sum() - m * (m + 1) / 2) / (m * n)
    assert metrics.ranked_metrics(df, [], "s", "y").first().auc == pytest.approx(wanted)


def test_prevalence_with_a_hot_code(skewed, spark):
    events = skewed.select("person_id", "event_age", "dt", F.when(F.col("rid") % 3 != 0, "A00").otherwise("B00").alias("code"))
    persons = skewed.select("person_id").distinct()
    got = {r.code: (r.n_entry, r.n_person) for r in registry.prevalence(events, persons, "code").collect()}
    assert got == {"A00": (20000, 500), "B00": (10000, 1)}


def test_exclusion_counts_match_single_steps(tables):
    rows = cleaning.clean_lab(tables.labx, RULES)
    reasons = cohort.reason_table(
        [
            cohort.first_event(registry.matching(tables.code, "^A0"), "a"),
            cohort.first_event(registry.matching(tables.code, "^B0"), "b"),
        ]
    )
    base = F.lit("1999-01-01").cast("date")
    table = cohort.exclusion_counts(rows, reasons, ["a", "b"], base).collect()
    assert table[-1].n_persons_left == cohort.exclude(rows, reasons, base).select("person_id").distinct().count()
    assert sum(r.n_persons_removed for r in table) + table[-1].n_persons_left == table[0].n_persons_left


def test_filters_and_columns_reach_the_scan(tables):
    text = plan(select_code(tables.raw("lineitem"), "l_linenumber", "3", ["l_orderkey", "l_quantity"]))
    assert "EqualTo(l_linenumber,3)" in text
    assert "struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in text


def test_draw_is_cut_per_group_before_the_exchange(tables):
    rows = recall.prob_bins(
        recall.site_label(tables.pred.withColumn("prob", F.col("p1")), tables.person), recall.Bins(0.0, (0.3, 0.6, 1.0))
    )
    assert "WindowGroupLimit" in plan(recall.stratified_draw(rows, {1: 10.0, 2: 10.0, 3: 10.0}))


@pytest.mark.parametrize("name", ["clean_lab", "history_sumstats", "code_matrix", "lab_matrix", "subgroups", "compare_models", "delong"])
def test_headline_plans_have_no_product_join(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "ArrowEvalPython" not in text


def test_score_table_computes_its_scores_once(tables):
    frame = metrics.ranked_metrics(tables.pred, ["split_set"], "p1", "y")
    frame.collect()
    assert "ReusedExchange" in plan(frame) or "TableCacheQueryStage" in plan(frame)


def test_windows_over_persons_run_on_daily_rows(skewed):
    daily = cleaning.daily_last(skewed).withColumn("abnorm_custom", (F.col("value") > 99).cast("double"))
    runs = series.abnormal_runs(daily)
    assert runs.groupBy("person_id").count().agg(F.max("count")).first()[0] <= 700


def test_position_cells_split_a_hot_group(skewed):
    placed = ranking.random_position(skewed.select("person_id", "rid"), ["person_id"], ["rid"], "z")
    hot = placed.where("person_id = -1")
    assert hot.count() == 10000 and hot.agg(F.countDistinct("pos")).first()[0] == 10000
