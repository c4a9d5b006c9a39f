"""Boundary values and small hand-made tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from labtrail.functions import recode, texts, thresholds, units
from labtrail.models import boosting
from labtrail.operators import cleaning, cohort, history, registry, schema, series, tables
from labtrail.sources import readers


def day(text):
    return datetime.date.fromisoformat(text)


def flags(spark, lab, choice, rows):
    df = spark.createDataFrame(rows, "value double, event_age double")
    return [r[0] for r in df.select(thresholds.abnormal(lab, choice)).collect()]


@pytest.mark.parametrize(
    "lab, choice, rows, wanted",
    [
        ("egfr", "KDIGO-soft", [(59.9, 50.0), (60.0, 50.0), (65.0, 50.0), (65.1, 50.0), (None, 50.0)], [1, 0.5, 0.5, 0, 0]),
        ("egfr", "KDIGO-soft2", [(70.0, 50.0), (70.1, 50.0)], [0.5, 0]),
        ("egfr", "herold-full", [(59.0, 25.0), (74.0, 30.0), (74.0, 25.0), (69.0, 40.0), (36.0, 80.0), (34.0, 80.0)], [1, 1, 0, 1, 0, 1]),
        ("egfr", "herold-part", [(59.0, 59.9), (59.0, 60.0), (49.0, 60.0)], [1, 0, 1]),
        ("uacr", "", [(2.9, 1.0), (3.0, 1.0), (3.1, 1.0), (30.0, 1.0), (220.0, 1.0), (221.0, 1.0), (None, 1.0)], [0, 3, 1, 1, 2, 3, 3]),
        ("hba1c", "soft", [(42.0, 1.0), (42.1, 1.0), (None, 1.0)], [0, 1, None]),
        ("hba1c", "strong", [(47.0, 1.0), (47.1, 1.0)], [0, 1]),
        ("tsh", "multi", [(0.39, 1.0), (0.4, 1.0), (4.0, 1.0)], [-1, 0, 1]),
        ("tsh", "simple", [(4.0, 1.0), (4.1, 1.0)], [0, 1]),
        ("cystc", "", [(1.1, 50.0), (1.1, 51.0), (1.2, 60.0), (1.21, 60.0), (None, 40.0)], [1, 0, 0, 1, None]),
        ("ldl", "", [(3.9, 1.0), (4.0, 1.0), (None, 1.0)], [0, 1, 1]),
        ("t4", "", [(9.0, 1.0), (9.1, 1.0), (23.0, 1.0), (23.1, 1.0)], [-1, 0, 0, 1]),
    ],
)
def test_threshold_boundaries(spark, lab, choice, rows, wanted):
    assert flags(spark, lab, choice, rows) == wanted


def test_threshold_choice_is_required():
    with pytest.raises(ValueError):
        thresholds.abnormal("tsh")
    with pytest.raises(ValueError):
        thresholds.abnormal("unknown lab")


def test_rate_equations(spark):
    df = spark.createDataFrame([(88.4, "male", 50), (88.4, "female", 50), (88.4, None, 50)], "v double, s string, a int")
    got = [r[0] for r in df.select(units.egfr_2021(F.col("v"), F.col("s"), F.col("a"), 0.7)).collect()]
    male = 142 * (1 / 0.9) ** -1.2 * 0.9938**50
    female = 142 * (1 / 0.7) ** -1.2 * 0.9938**50 * 1.012
    assert got == pytest.approx([male, female, female])
    written = df.select(units.egfr_2021(F.col("v"), F.col("s"), F.col("a"))).collect()[1][0]
    assert written == pytest.approx(142 * (1 / 0.9) ** -1.2 * 0.9938**50 * 1.012)


def test_filled_rows_keep_their_unit_rules(spark):
    df = spark.createDataFrame(
        [(None, "L", None), (None, "HH", None), (None, "H", "x"), (5.0, "L", "x"), (None, None, "x")],
        "v double, f string, u string",
    )
    dummies = {"L": 1.0, "N": 2.0, "H": -1, "LL": 0.5, "HH": 9.0}
    got = df.select(
        units.filled_value(F.col("v"), F.col("f"), dummies),
        units.filled_unit(F.col("v"), F.col("f"), F.col("u"), dummies, "mmol"),
    ).collect()
    assert [tuple(r) for r in got] == [(1.0, "mmol"), (9.0, None), (None, None), (5.0, "x"), (None, "x")]


RUN = [
    (1, day("2000-01-01"), -1.0),
    (1, day("2000-02-01"), -1.0),
    (2, day("2000-01-01"), 1.0),
    (2, day("2000-03-31"), 1.0),
    (2, day("2000-04-01"), 0.0),
    (2, day("2000-05-01"), 1.0),
    (3, day("2000-01-01"), 1.0),
    (4, day("2000-01-01"), 1.0),
    (4, day("2000-02-01"), None),
    (4, day("2000-12-01"), 1.0),
]


def test_runs_and_sustained_abnormality(spark):
    df = spark.createDataFrame(RUN, "person_id long, dt date, abnorm_custom double")
    runs = {(r.person_id, r.dt): (r.start_dt, r["diff"]) for r in series.abnormal_runs(df).collect()}
    # a first flag of -1 starts a run of its own
    assert runs[(1, day("2000-02-01"))] == (day("2000-01-01"), 31)
    assert runs[(2, day("2000-05-01"))] == (day("2000-05-01"), 0)
    # persons with one row are left out, rows without a flag do not break a run
    assert (3, day("2000-01-01")) not in runs
    assert runs[(4, day("2000-12-01"))][0] == day("2000-01-01")
    found = {r.person_id: r for r in series.data_diagnosis(df, 90).collect()}
    assert set(found) == {2, 4}
    assert found[2].diagnosis_dt == day("2000-03-31") and found[2]["diff"] == 90


def test_second_date_needs_two_distinct_days(spark):
    rows = [(1, day("2000-01-01")), (1, day("2000-01-01")), (2, day("2000-01-01")), (2, day("2000-06-01"))]
    df = spark.createDataFrame(rows, "person_id long, dt date")
    assert [tuple(r) for r in series.second_dates(df).collect()] == [(2, day("2000-06-01"))]


def test_unit_conflict_keeps_highest_unit_then_value(spark):
    rows = [
        (1, 1, 50, day("2000-01-01"), 5.0, "%"),
        (2, 1, 50, day("2000-01-01"), 7.0, "mmol/mol"),
        (3, 1, 50, day("2000-01-01"), 8.0, "mmol/mol"),
        (4, 2, 50, day("2000-01-01"), 5.0, None),
        (5, 2, 50, day("2000-01-01"), 6.0, None),
        (6, 3, 50, day("2000-01-01"), 6.0, None),
    ]
    df = spark.createDataFrame(rows, "rid long, person_id long, event_age int, dt date, value double, unit string")
    got = {r.person_id: (r.value, r.unit) for r in cleaning.dedup_unit_priority(df, "mmol/mol").collect()}
    assert got == {1: (8.0, "mmol/mol"), 2: (6.0, "mmol/mol"), 3: (6.0, None)}


def test_single_row_and_equal_values_in_history(spark):
    rows = [(1, day("2000-01-01"), 5.0, 0.5), (2, day("2000-01-01"), 7.0, 1.0), (2, day("2000-02-01"), 7.0, 1.0)]
    df = spark.createDataFrame(rows, "person_id long, dt date, value double, abnorm_custom double")
    labels = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 0.0)], "person_id long, split_set double")
    start = F.lit("2000-03-01").cast("date")
    stats = history.history_sumstats(df, labels, start)
    got = {r.person_id: r for r in stats.collect()}
    assert got[1].SD is None and got[1].SUM_CHANGE == 0 and got[1].MEAN_CHANGE is None and got[1].ABNORM == 0
    assert got[2].SD == 0 and got[2].KURT is None and got[2].ABNORM == 2 and got[2].FIRST_LAST == pytest.approx(31 / 365.25)
    filled = {r.person_id: r for r in history.mean_impute(stats, labels, 1).collect()}
    assert filled[3].NO_HISTORY == 1 and filled[3].MEAN == 5.0 and filled[3].SD is None and filled[3].SEQ_LEN == 0


def test_interpolation_fills_only_between_known_months(spark):
    rows = [(1, day("2000-01-01"), None), (1, day("2000-02-01"), 2.0), (1, day("2000-03-01"), None), (1, day("2000-04-01"), 6.0), (1, day("2000-05-01"), None)]
    df = spark.createDataFrame(rows, "person_id long, dt date, value double")
    got = [r.value for r in series.interpolate(df, ["value"]).orderBy("dt").collect()]
    assert got == [None, 2.0, 4.0, 6.0, None]


def test_attrition_adds_up(spark):
    rows = [
        (1, 1, "male", 40, day("2000-01-01"), 100.0, "umol/l", "N"),
        (2, 1, "male", 40, day("2000-01-01"), 100.0, "umol/l", "N"),
        (3, 1, "male", 40, day("2000-01-01"), 120.0, "umol/l", "N"),
        (4, 1, "male", 40, day("2000-02-01"), None, "umol/l", "H"),
        (5, 2, "male", 10, day("2000-02-01"), 90.0, "umol/l", "H"),
        (6, 3, "male", 40, day("2000-02-01"), 90.0, "mg/dl", "H"),
        (7, 4, "male", 40, day("2000-02-01"), 90.0, "umol/l", "H"),
        (8, 4, "male", 40, day("2000-03-01"), 95.0, "umol/l", "H"),
    ]
    df = spark.createDataFrame(
        rows, "rid long, person_id long, sex string, event_age int, dt date, value double, unit string, flag string"
    )
    rules = cleaning.CleanRules(lab="egfr", unit="umol/l", min_age=18)
    table = {r.step: r for r in cleaning.attrition(df, rules).collect()}
    steps = list(cleaning.STEPS)
    for before, after in zip(steps, steps[1:]):
        assert table[before].n_rows_now - table[after].n_rows_removed == table[after].n_rows_now
    assert [table[s].n_rows_now for s in steps[:6]] == [8, 7, 6, 5, 4, 3]
    assert table["Unit"].n_persons_removed == 1
    assert table["Outliers_single"].n_rows_now == cleaning.clean_lab(df, rules).count()


def test_stratified_split_shares(spark):
    frame = spark.range(1000).select(F.col("id").alias("person_id"), (F.col("id") % 3).alias("s"))
    split = cohort.stratified_split(frame, ["s"], 0.1, 0.1)
    counts = split.groupBy("s", "split_set").count().collect()
    for r in counts:
        size = {0: 334, 1: 333, 2: 333}[r.s]
        wanted = {0.0: 0.8, 1.0: 0.1, 0.5: 0.1}[r.split_set] * size
        assert abs(r["count"] - wanted) <= 1
    with pytest.raises(ValueError):
        cohort.test_sample(frame, frame)


def test_schema_rules(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2**40, 1.5)], "k long, v double")
    out = schema.promote_union([a, b])
    assert dict(out.dtypes) == {"k": "bigint", "v": "string"}
    groups = {"SUMSTATS": ["person_id", "MEAN", "SD", "LAST_VAL_DATE"], "ICD_MAT": ["person_id", "I10"]}
    assert schema.feature_groups(["SEX", "SUMSTATS_MEAN", "ICD_MAT"], groups) == ["SEX", "MEAN", "I10"]
    with pytest.raises(ValueError):
        readers.read_file(spark, "table.xlsx")


def test_small_texts(spark):
    df = spark.createDataFrame([(532,), (1234,), (1500,), (2500,), (1200000,)], "n long")
    assert [r[0] for r in df.select(texts.pretty_count(F.col("n"))).collect()] == ["532", "1K", "2K", "2K", "1.2M"]
    ages = spark.createDataFrame([(29.9,), (30.0,), (40.0,), (60.0,), (70.0,), (70.1,)], "a double")
    bands = [r[0] for r in ages.select(recode.age_band(F.col("a"))).collect()]
    assert bands == [None, "30-40", "40-50", "60-70", "60-70", None]


def test_objectives_and_search():
    assert boosting.objective("mlogloss") == "multi"
    with pytest.raises(ValueError):
        boosting.objective("q10")
    assert boosting.random_settings(3) == boosting.random_settings(3)


def test_replicates_of_the_bootstrap_are_independent():
    """Draws of two replicates over 10**7 places agree no more often than chance, at any shift."""
    import numpy as np

    from labtrail.functions.uniform import LOW_BITS, MIX_PRIME, MIX_ROUNDS

    def draws(pos, replicate):
        low, high, found = pos & ((1 << LOW_BITS) - 1), pos >> LOW_BITS, []
        for rounds in MIX_ROUNDS.values():
            h = low % MIX_PRIME
            for k, (factor, by_factor, by_sum, by_high) in enumerate(rounds):
                h = h ^ (h >> 15)
                h = (h * ((factor + replicate * by_factor) % MIX_PRIME) % MIX_PRIME + replicate * by_sum + high * by_high + 11 * (k + 1)) % MIX_PRIME
            found.append(h)
        return found[0] * (1 << 31) + found[1]

    n = 10**7
    pos = np.arange(n, dtype=np.int64)
    assert (draws(pos, 1) % n == draws(pos, 68) % n).sum() < 15
    n, pos = 10**6, pos[: 10**6]
    whole = {r: draws(pos, r) for r in (1, 2, 68)}
    for r in (2, 68):
        assert (whole[1] % n == whole[r] % n).sum() < 15
        # no run of one replicate is a run of another, as it would be after a shift
        assert len(np.intersect1d(whole[1], whole[r])) < 5
    assert len(np.unique(whole[1])) > n - 5
    share = np.unique(whole[1] % n).size / n
    assert abs(share - (1 - np.exp(-1))) < 0.002
    far = draws(pos[:1000] + (1 << 33), 1)
    assert not np.intersect1d(far, whole[1]).size


def test_names_of_any_length(spark):
    from labtrail.functions.texts import feature_labels

    long = "X" * 1500
    found = feature_labels(
        spark.createDataFrame([(f"S_{long}",), (long,)], "feature string"),
        spark.createDataFrame([("c", "d")], "concept_id string, concept_name string"),
        "egfr",
    )
    assert {r.label for r in found.collect()} == {long}


def test_several_flags_on_one_day(spark):
    """The order within a day does not depend on how rows are dealt."""
    from labtrail.operators import series

    rows = [(1, f"2020-01-0{d}", float(f), float(v)) for d, f, v in ((1, 0, 5), (2, 1, 4), (2, 0, 9), (2, 1, 4), (3, 1, 2), (4, 1, 7))]
    table = spark.createDataFrame(rows, "person_id long, dt string, abnorm_custom double, value double").withColumn("dt", F.to_date("dt"))
    for operator in (series.abnormal_runs, series.change_from_previous, lambda x: series.previous_flag(x, "abnorm_custom")):
        results = {tuple(sorted(map(repr, operator(table.repartition(n, "value")).collect()))) for n in (1, 3, 7)}
        results.add(tuple(sorted(map(repr, operator(table.orderBy(F.desc("value"))).collect()))))
        assert len(results) == 1


def test_final_cohort_ages(spark):
    """Persons of 30 to 70 stay, both ends included; unknown ages and persons with an earlier reason go."""
    births = {1: 1994, 2: 1993, 3: 1962, 4: 1953, 5: 1951, 6: None, 7: 1970}
    date = F.lit(day("2023-12-31"))
    persons = spark.createDataFrame([(k, y and day(f"{y}-01-01")) for k, y in births.items()], "person_id long, birth_date date")
    rows = spark.createDataFrame([(k, "male", 50) for k in births for _ in range(2)], "person_id long, sex string, event_age int")
    reasons = spark.createDataFrame([(7, "data", day("2020-01-01")), (3, "data", day("2024-01-01"))], "person_id long, reason string, first_dt date")
    found = sorted((r.person_id, r.event_age) for r in cohort.final_cohort(rows, reasons, persons, date).collect())
    assert found == [(2, 30), (3, 61), (4, 70)]
    assert cohort.final_cohort(rows, reasons, persons, date, 30, 60).count() == 1


def test_frequent_code_matrix(spark):
    """Codes of one letter stay apart, letters beyond J count, and rare codes have no column."""
    rows = [(k, "Z10", 40) for k in range(8)] + [(0, "Z10", 40), (1, "Z11", 40), (2, "Z11", 40), (3, "A01", 40), (4, "A01", 90)]
    events = spark.createDataFrame(rows, "person_id long, three string, event_age int")
    persons = spark.range(10).withColumnRenamed("id", "person_id")
    wide, codes = registry.frequent_code_matrix(events, events, persons, "three", 0.2)
    assert codes == ["Z10", "Z11"]
    found = {r.person_id: (r.Z10, r.Z11) for r in wide.collect()}
    assert found == {0: (2, 0), 1: (1, 1), 2: (1, 1), 8: (0, 0), 9: (0, 0)} | {k: (1, 0) for k in range(3, 8)}


def test_ranked_rows(spark):
    """Places over many ranges, with ties of the first column."""
    rows = [(f"c{k}", k % 7) for k in range(3000)]
    counts = spark.createDataFrame(rows, "code string, n long").repartition(5)
    found = tables.ranked_rows(counts, [F.desc("n"), F.asc_nulls_last("code")])
    ordered = [r.code for r in sorted(found.collect(), key=lambda r: r.place)]
    assert ordered == [c for c, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert sorted(r.place for r in found.collect()) == list(range(1, 3001))
