"""Exclusions, labels, ages and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.functions import dates, thresholds
from labtrail.operators.ranking import random_position
from labtrail.operators.series import PERSON, data_diagnosis, second_dates

# ---------------------------------------------------------------- exclusions


def first_event(events: DataFrame, reason: str) -> DataFrame:
    """(person, reason, first date); combined per person on the map side."""
    return (
        events.groupBy(PERSON)
        .agg(F.min("dt").alias("first_dt"))
        .select(PERSON, F.lit(reason).alias("reason"), "first_dt")
    )


def first_events(events: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """(person, reason, first date) of several kinds of events in one scan."""
    firsts = events.groupBy(PERSON).agg(
        *[F.min(F.when(test, F.col("dt"))).alias(reason) for reason, test in tests.items()]
    )
    lines = [
        F.struct(F.lit(r).alias("reason"), F.col(f"`{r}`").alias("first_dt")) for r in tests
    ]
    return firsts.select(PERSON, F.inline(F.array(*lines))).where(F.col("first_dt").isNotNull())


def second_event(events: DataFrame, reason: str) -> DataFrame:
    """(person, reason, second distinct date)."""
    return second_dates(events).select(PERSON, F.lit(reason).alias("reason"), F.col("dt").alias("first_dt"))


def reason_table(parts: Sequence[DataFrame]) -> DataFrame:
    """One table of reasons, built once and used for any base date."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def excluded_before(reasons: DataFrame, base: Column) -> DataFrame:
    return reasons.where(F.col("first_dt") < base).select(PERSON).distinct()


def exclude(series: DataFrame, reasons: DataFrame, base: Column) -> DataFrame:
    """Rows of persons without any reason before `base`; persons without events stay.

    A cleaned series has no repeated rows, so the anti join is all it takes.
    """
    return series.join(excluded_before(reasons, base), PERSON, "left_anti")


def kidney_reasons(
    series: DataFrame, coded: DataFrame, cystatin: DataFrame, albumin: DataFrame, days: int = 90
) -> DataFrame:
    """Sustained low rate, coded events, cystatin rate < 60, albumin ratio >= 30.

    `coded` holds the reasons found in registries (diagnosis, SGLT2 drug,
    nephrectomy), see `first_events`; so it does for the other labs.
    """
    sustained = data_diagnosis(series.where(F.col("abnorm_custom") != 0.5), days)
    return reason_table(
        [
            sustained.select(
                PERSON, F.lit("data").alias("reason"), F.col("diagnosis_dt").alias("first_dt")
            ),
            coded,
            first_event(cystatin.where(F.col("value") < 60), "cystatin"),
            first_event(albumin.where(F.col("value") >= 30), "albumin"),
        ]
    )


def sugar_reasons(
    series: DataFrame, coded: DataFrame, fasting: DataFrame, glucose: DataFrame
) -> DataFrame:
    """Abnormal value, coded events, fasting glucose >= 7 twice, glucose >= 11 twice."""
    return reason_table(
        [
            first_event(series.where(F.col("abnorm_custom") == 1), "data"),
            coded,
            second_event(fasting.where(F.col("value") >= 7), "fasting glucose"),
            second_event(glucose.where(F.col("value") >= 11), "glucose"),
        ]
    )


def fat_reasons(
    series: DataFrame, coded: DataFrame, fasting: DataFrame, any_time: DataFrame
) -> DataFrame:
    """LDL >= 4, coded events, fasting triglycerides >= 5.6 once, any >= 5.6 twice."""
    return reason_table(
        [
            first_event(series.where(F.col("value") >= 4), "data"),
            coded,
            first_event(fasting.where(F.col("value") >= 5.6), "fasting triglycerides"),
            second_event(any_time.where(F.col("value") >= 5.6), "triglycerides"),
        ]
    )


def thyroid_reasons(
    series: DataFrame, coded: DataFrame, t4: DataFrame, t3: DataFrame
) -> DataFrame:
    """Any abnormal value, coded events, abnormal T4 or T3."""
    odd = F.col("abnorm_custom") != 0
    return reason_table(
        [
            first_event(series.where(odd), "data"),
            coded,
            first_event(t4.where(odd), "t4"),
            first_event(t3.where(odd), "t3"),
        ]
    )


def exclusion_counts(
    series: DataFrame, reasons: DataFrame, order: Sequence[str], base: Column
) -> DataFrame:
    """Persons and rows removed by each rule and left after it.

    A person is charged to the first rule in `order` that removes them, so the
    whole cascade is one aggregation.
    """
    number = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("reason"))
    hit = reasons.where(F.col("first_dt") < base).groupBy(PERSON).agg(F.min(number).alias("_no"))
    persons = (
        series.groupBy(PERSON)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(hit, PERSON, "left")
        .withColumn("_no", F.coalesce("_no", F.lit(len(order) + 1)))
    )
    steps = range(len(order) + 1)
    totals = persons.agg(
        *[F.count_if(F.col("_no") == s).alias(f"p{s}") for s in steps],
        *[F.coalesce(F.sum(F.when(F.col("_no") == s, F.col("n"))), F.lit(0)).alias(f"r{s}") for s in steps],
        *[F.count_if(F.col("_no") > s).alias(f"pl{s}") for s in steps],
        *[F.coalesce(F.sum(F.when(F.col("_no") > s, F.col("n"))), F.lit(0)).alias(f"rl{s}") for s in steps],
    )
    lines = [
        F.struct(
            F.lit(s).alias("step_no"),
            F.lit(name).alias("step"),
            F.col(f"p{s}").alias("n_persons_removed"),
            F.col(f"r{s}").alias("n_rows_removed"),
            F.col(f"pl{s}").alias("n_persons_left"),
            F.col(f"rl{s}").alias("n_rows_left"),
        )
        for s, name in enumerate(["start", *order])
    ]
    return totals.select(F.inline(F.array(*lines)))


# -------------------------------------------------------------------- labels

GOALS = ("y_mean", "y_min", "y_next")
LABEL_COLUMNS = (PERSON, "sex", "y_mean", "y_mean_abnorm", "y_min", "y_min_abnorm", "y_next", "y_next_abnorm")


def _with_flags(labels: DataFrame, lab: str, choice: str) -> DataFrame:
    return labels.withColumns(
        {f"{g}_abnorm": thresholds.abnormal(lab, choice, g, "event_age") for g in GOALS}
    ).select(*LABEL_COLUMNS)


def _in_window(series: DataFrame, start: Column, end: Column) -> DataFrame:
    return series.where((F.col("dt") >= start) & (F.col("dt") <= end))


def window_stats(series: DataFrame, start: Column, end: Column, lab: str) -> DataFrame:
    """Mean, extreme and first value per person inside the window.

    The extreme is the minimum for the filtration rate and the maximum for every
    other lab. Age-based rules use the age at the first value.
    """
    extreme = F.min("value") if lab == "egfr" else F.max("value")
    first = F.min(F.struct("dt", "value"))
    return _in_window(series, start, end).groupBy(PERSON, "sex").agg(
        F.avg("value").alias("y_mean"),
        extreme.alias("y_min"),
        first["value"].alias("y_next"),
        F.min("event_age").alias("event_age"),
    )


def yearly_stats(series: DataFrame, start: Column, end: Column, lab: str) -> DataFrame:
    """Yearly mean, minimum and first value, then the extreme over the years."""
    per_year = (
        _in_window(series, start, end)
        .groupBy(PERSON, "sex", F.year("dt").alias("year"))
        .agg(
            F.avg("value").alias("mean"),
            F.min("value").alias("low"),
            F.min(F.struct("dt", "value"))["value"].alias("first"),
            F.min("event_age").alias("event_age"),
        )
    )
    worst = F.min if lab == "egfr" else F.max
    return per_year.groupBy(PERSON, "sex").agg(
        worst("mean").alias("y_mean"),
        worst("low").alias("y_min"),
        F.min(F.struct("year", "first"))["first"].alias("y_next"),
        F.min("event_age").alias("event_age"),
    )


def labels(series: DataFrame, start: Column, end: Column, lab: str, choice: str = "") -> DataFrame:
    return _with_flags(window_stats(series, start, end, lab), lab, choice)


def labels_per_year(
    series: DataFrame, start: Column, end: Column, lab: str, choice: str = ""
) -> DataFrame:
    return _with_flags(yearly_stats(series, start, end, lab), lab, choice)


def with_age(df: DataFrame, persons: DataFrame, date: Column) -> DataFrame:
    """Add `event_age` at `date` from the birth date; unknown persons get null."""
    # persons grow with the input: a shuffled join, or they are broadcast through the driver
    births = persons.select(PERSON, "birth_date").hint("merge")
    return (
        df.join(births, PERSON, "left")
        .withColumn("event_age", dates.age_at(date, F.col("birth_date")))
        .drop("birth_date")
    )


def final_cohort(
    series: DataFrame, reasons: DataFrame, persons: DataFrame, date: Column, min_age: float = 30, max_age: float = 70
) -> DataFrame:
    """Persons without a reason before `date` whose age then is within the bounds, with label 0; an
    unknown age goes."""
    aged = with_age(exclude(series, reasons, date).drop("event_age"), persons, date)
    inside = aged.where(F.col("event_age").between(min_age, max_age))
    return inside.select(PERSON, "sex", "event_age", F.lit(0).alias("y_mean_abnorm")).distinct()


def age_restrict(
    df: DataFrame, persons: DataFrame, date: Column, low: float, high: float
) -> DataFrame:
    """Drop persons outside [low, high] at `date`; an unknown age stays."""
    outside = (F.col("event_age") < low) | (F.col("event_age") > high)
    return with_age(df, persons, date).where(~F.coalesce(outside, F.lit(False)))


def cohort_members(
    persons: DataFrame, cohorts: Sequence[str], with_components: DataFrame | None = None
) -> DataFrame:
    """Persons of the named biobanks, optionally only those with genetic components."""
    members = persons.where(F.col("cohort").isin(*cohorts)).select(PERSON)
    if with_components is None:
        return members
    known = with_components.where(F.col("pc1").isNotNull()).select(PERSON).distinct()
    return members.join(known, PERSON, "left_semi")


def case_counts(frame: DataFrame, goals: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Persons, cases and percent of cases per goal."""
    lines = [F.struct(F.lit(n).alias("goal"), F.col(c).alias("case")) for n, c in goals.items()]
    long = frame.select(*keys, F.inline(F.array(*lines)))
    return long.groupBy(*keys, "goal").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("case").alias("n_cases"),
        F.round(F.sum("case") / F.count(F.lit(1)) * 100, 2).alias("pct_cases"),
    )


# -------------------------------------------------------------------- splits


def test_sample(
    frame: DataFrame,
    eligible: DataFrame,
    n: int | None = None,
    share: float | None = None,
    salt: str = "test",
) -> DataFrame:
    """Random persons of fixed number or share among the eligible ones."""
    if (n is None) == (share is None):
        raise ValueError("give either n or share")
    pool = frame.select(PERSON).join(eligible.select(PERSON).distinct(), PERSON, "left_semi")
    placed = random_position(pool, [], [PERSON], salt)
    limit = F.lit(n) if n is not None else F.floor(F.col("n_group") * F.lit(float(share)))
    return placed.where(F.col("pos") < limit).select(PERSON)


def _count_of(share: float, size: Column) -> Column:
    return F.floor(size * F.lit(float(share)) + 0.5)


def stratified_split(
    frame: DataFrame,
    strata: Sequence[str],
    tuning: float = 0.1,
    fine_tune: float = 0.1,
    salt: str = "split",
) -> DataFrame:
    """Add split_set: 0 train, 1 tuning, 0.5 fine-tuning, with equal shares per stratum."""
    stratum = F.concat_ws("|", *[F.coalesce(F.col(s).cast("string"), F.lit("none")) for s in strata])
    placed = random_position(frame.withColumn("_stratum", stratum), ["_stratum"], [PERSON], salt)
    total = tuning + fine_tune
    held = _count_of(total, F.col("n_group"))
    code = F.when(F.col("pos") >= held, 0.0)
    code = code.when(F.col("pos") < _count_of(tuning / total, held), 1.0).otherwise(0.5)
    return placed.withColumn("split_set", code).drop("pos", "n_group", "_stratum")


def future_split(earlier: DataFrame, later: DataFrame, test_ids: DataFrame) -> DataFrame:
    """The earlier period is training; the later one is tuning and test."""
    chosen = test_ids.select(PERSON).distinct()
    return (
        earlier.withColumn("split_set", F.lit(0.0))
        .unionByName(later.join(chosen, PERSON, "left_anti").withColumn("split_set", F.lit(1.0)))
        .unionByName(later.join(chosen, PERSON, "left_semi").withColumn("split_set", F.lit(2.0)))
    )


def pre_base_history(series: DataFrame, frame: DataFrame, base: Column) -> DataFrame:
    """Rows before `base` of labelled persons."""
    return series.where(F.col("dt") < base).join(
        frame.select(PERSON).distinct(), PERSON, "left_semi"
    )
