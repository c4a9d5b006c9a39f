"""Cleaning of one laboratory series with attrition accounting.

Rows of one person and day are combined by aggregation before anything is
ordered, so a person with very many raw rows is reduced on the map side. The
cleaned series has at most a few rows per person and day, which bounds every
later window over a person by the number of calendar days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail.functions import recode, thresholds, units
from labtrail.operators import extract

ROW_KEY = ("person_id", "dt", "value", "unit")
DATE_KEY = ("person_id", "dt")


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of `keys` between two aliased frames."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def dedup_exact(df: DataFrame, keys: Sequence[str] = ROW_KEY, order: str = "rid") -> DataFrame:
    """One row per key: the one that is first in `order`. Null keys are equal."""
    rest = [c for c in df.columns if c not in keys and c != order]
    kept = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def flag_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs more than once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return df.alias("a").join(repeated.alias("b"), same("a", "b", keys), "left_semi")


def dedup_none(df: DataFrame, keys: Sequence[str] = DATE_KEY) -> DataFrame:
    """Rows whose key occurs exactly once."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row")
    )
    return grouped.where("_n = 1").select(*keys, "_row.*").select(*df.columns)


def _best_of_date(df: DataFrame, priority_unit: str, sums: Mapping[str, Column]) -> DataFrame:
    """The row with the highest (age, unit, value), nulls last, per person and date."""
    ranked = ("event_age", "unit", "value")
    rest = [c for c in df.columns if c not in (*DATE_KEY, *ranked, "rid")]
    best = F.max(F.struct(*ranked, (-F.col("rid")).alias("_back"), "rid", *rest))
    grouped = df.groupBy(*DATE_KEY).agg(
        best.alias("_row"),
        F.count(F.lit(1)).alias("_n"),
        *[c.alias(n) for n, c in sums.items()],
    )
    repeated = F.coalesce(F.col("unit"), F.lit(priority_unit))
    return grouped.select(*DATE_KEY, "_row.*", "_n", *sums).withColumn(
        "unit", F.when(F.col("_n") > 1, repeated).otherwise(F.col("unit"))
    )


def dedup_unit_priority(df: DataFrame, priority_unit: str) -> DataFrame:
    """One row per person and date; a repeated row without unit gets `priority_unit`."""
    return _best_of_date(df, priority_unit, {}).select(*df.columns)


def same_day_mean(df: DataFrame, day: str = "dt") -> DataFrame:
    """Mean value per person, day, age, sex and, where present, flag and unit."""
    keys = [c for c in ("event_age", "sex", "flag", "unit", "abnorm") if c in df.columns]
    return df.groupBy("person_id", F.to_date(day).alias("dt"), *keys).agg(
        F.avg("value").alias("value")
    )


def last_of_day(df: DataFrame, stamp: str = "ts") -> DataFrame:
    """Rows at the last timestamp of each person and day; ties stay."""
    last = df.groupBy("person_id", F.to_date(stamp).alias("_day")).agg(F.max(stamp).alias(stamp))
    return df.join(last.drop("_day"), ["person_id", stamp], "left_semi")


def daily_last(df: DataFrame, order: str = "rid") -> DataFrame:
    """One row per person and day: the last in `order`. The base of all ordered work."""
    rest = [c for c in df.columns if c not in (*DATE_KEY, order)]
    best = df.groupBy(*DATE_KEY).agg(F.max(F.struct(order, *rest)).alias("_row"))
    return best.select(*DATE_KEY, "_row.*").select(*df.columns)


def known_outliers(df: DataFrame, low: float | None, high: float | None) -> DataFrame:
    return df.where(in_reference_range(F.col("value"), low, high))


def in_reference_range(value: Column, low: float | None, high: float | None) -> Column:
    """True inside the given bounds; a missing bound does not limit."""
    test = value.isNotNull()
    if low is not None:
        test = test & (value >= low)
    if high is not None:
        test = test & (value <= high)
    return test


def zscore_global(df: DataFrame, value: str = "value") -> DataFrame:
    """Population z-score over the whole lab, from one aggregated row."""
    stats = df.agg(
        F.struct(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")).alias("s")
    ).scalar()
    z = F.try_divide(F.col(value) - F.col("_s")["mean"], F.col("_s")["sd"])
    return df.withColumn("_s", stats).withColumn("z", z).drop("_s")


def severe_outliers(df: DataFrame, max_z: float) -> DataFrame:
    return zscore_global(df).where(F.abs("z") < max_z).drop("z")


def severe_bounds(df: DataFrame, max_z: float) -> DataFrame:
    """Smallest value removed above and largest value removed below."""
    return zscore_global(df).agg(
        F.min(F.when(F.col("z") >= max_z, F.col("value"))).alias("removed_from"),
        F.max(F.when(F.col("z") <= -max_z, F.col("value"))).alias("removed_to"),
    )


def zscore_person(df: DataFrame, value: str = "value") -> DataFrame:
    """Sample z-score within the person; null where the person does not vary."""
    stats = df.groupBy("person_id").agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd")
    )
    return (
        df.join(stats, "person_id")
        .withColumn("z", F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd")))
        .drop("_mean", "_sd")
    )


# fixed values: when a person's only extreme value is an error
HIGH_CANDIDATE_Z, HIGH_Z, HIGH_VALUE = 2.5, 5, 175
LOW_Z, LOW_VALUE = -4, 50


def _single_outlier(z: Column, value: Column, n_high: Column, n_low: Column) -> Column:
    high = (n_high == 1) & (z > HIGH_Z) & (value > HIGH_VALUE)
    low = (n_low == 1) & (z < LOW_Z) & (value < LOW_VALUE)
    return F.coalesce(high | low, F.lit(False))


def single_outliers(df: DataFrame) -> DataFrame:
    """Rows without the one extreme value of persons who have exactly one."""
    scored = zscore_person(df)
    counts = scored.groupBy("person_id").agg(
        F.count_if(F.col("z") > HIGH_CANDIDATE_Z).alias("_high"),
        F.count_if(F.col("z") < LOW_Z).alias("_low"),
    )
    bad = _single_outlier(F.col("z"), F.col("value"), F.col("_high"), F.col("_low"))
    return scored.join(counts, "person_id").where(~bad).select(*df.columns)


@dataclass(frozen=True)
class CleanRules:
    """Settings of one laboratory test."""

    lab: str
    unit: str
    choice: str = ""
    min_age: float = 0
    priority_unit: str | None = None
    dummies: Mapping[str, float] = field(default_factory=dict)
    low: float | None = None
    high: float | None = None
    max_z: float = 10
    keep_last_of_day: bool = False
    to_rate: bool = True
    female_max_k: float = 0.9


STEPS = (
    "Start",
    "Min age",
    "Dups exact",
    "Dups manual",
    "Values",
    "Unit",
    "Dups mean",
    "Outliers_known",
    "Outliers",
    "Outliers_single",
)
_KEPT = len(STEPS)


def _prepared(df: DataFrame, rules: CleanRules) -> DataFrame:
    rows = extract.min_age(df, rules.min_age)
    if rules.lab == "uacr":
        rows = extract.without_low_flag(rows)
    if rules.lab == "tsh":
        rows = rows.withColumn("unit", recode.thyroid_unit(F.col("unit")))
    if rules.lab in ("hba1c", "tsh"):
        rows = rows.withColumn("flag", recode.plain_flag(F.col("flag")))
    return rows.select("rid", "person_id", "sex", "event_age", "dt", "value", "unit", "flag")


def annotate(df: DataFrame, rules: CleanRules) -> DataFrame:
    """Every group of raw rows with the step that removes it (`drop_step`).

    `n_raw`, `n_exact` and `n_date` count the rows the group stood for before
    exact de-duplication, before unit de-duplication and before the day was
    collapsed; `drop_step` is the index in STEPS, or len(STEPS) for kept rows.
    """
    exact_keys = list(ROW_KEY)
    prepared = _prepared(df, rules)
    rest = ["event_age", "sex", "flag"]
    exact = (
        prepared.groupBy(*exact_keys)
        .agg(F.min(F.struct("rid", *rest)).alias("_row"), F.count(F.lit(1)).alias("n_raw"))
        .select(*exact_keys, "_row.*", "n_raw")
    )
    rows = _best_of_date(
        exact,
        rules.priority_unit or rules.unit,
        {"n_exact": F.count(F.lit(1)), "n_all": F.sum("n_raw")},
    ).withColumn("n_raw", F.col("n_all"))

    value, flag, unit = F.col("value"), F.col("flag"), F.col("unit")
    if rules.dummies:
        rows = rows.withColumns(
            {
                "unit": units.filled_unit(value, flag, unit, rules.dummies, rules.unit),
                "value": units.filled_value(value, flag, rules.dummies),
            }
        )
    drop = F.when(value.isNull(), STEPS.index("Values"))
    if rules.lab == "hba1c":
        rows = rows.withColumns(
            {"value": units.hba1c_mmol(value, unit), "unit": F.lit("mmol/mol")}
        )
    else:
        in_unit = F.coalesce(unit == rules.unit, F.lit(False))
        drop = drop.when(~in_unit, STEPS.index("Unit"))
    rows = rows.withColumns(
        {"drop_step": drop.otherwise(_KEPT), "abnorm": recode.ordinal_flag(flag)}
    )

    sums = [F.sum("n_raw").alias("n_raw"), F.sum("n_exact").alias("n_exact"), F.count(F.lit(1)).alias("n_date")]
    day = F.to_date("dt").alias("dt")
    if rules.keep_last_of_day:
        latest = F.max(F.struct(F.col("dt").alias("_at"), "rid", "event_age", "sex", "unit", "abnorm", "value"))
        rows = (
            rows.groupBy("person_id", day, "drop_step")
            .agg(latest.alias("_row"), *sums)
            .select("person_id", "dt", "drop_step", "n_raw", "n_exact", "n_date", "_row.*")
            .drop("_at", "rid")
        )
    else:
        rows = rows.groupBy(
            "person_id", day, "event_age", "sex", "abnorm", "unit", "drop_step"
        ).agg(F.avg("value").alias("value"), *sums)

    if rules.lab == "egfr" and rules.to_rate:
        rate = units.egfr_2021(value, F.col("sex"), F.col("event_age"), rules.female_max_k)
        rows = rows.withColumns({"value": rate, "unit": F.lit("ml/min/1.73m2")})
    if rules.lab == "cystc" and rules.to_rate:
        rows = rows.withColumn("value", units.cystatin_2012(value, F.col("sex"), F.col("event_age")))

    outside = ~in_reference_range(value, rules.low, rules.high)
    rows = _mark(rows, outside, "Outliers_known")
    stats = (
        rows.where(F.col("drop_step") == _KEPT)
        .agg(F.struct(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).alias("s"))
        .scalar()
    )
    z = F.try_divide(value - F.col("_s")["mean"], F.col("_s")["sd"])
    rows = rows.withColumn("_s", stats)
    rows = _mark(rows, ~F.coalesce(F.abs(z) < rules.max_z, F.lit(False)), "Outliers").drop("_s")
    if rules.lab in ("egfr", "tsh"):
        # at most a few rows per person and day remain, so this window is bounded
        person = Window.partitionBy("person_id")
        alive = F.when(F.col("drop_step") == _KEPT, value)
        rows = rows.withColumn(
            "_z", F.try_divide(alive - F.avg(alive).over(person), F.stddev_samp(alive).over(person))
        )
        n_high = F.count_if(F.col("_z") > HIGH_CANDIDATE_Z).over(person)
        n_low = F.count_if(F.col("_z") < LOW_Z).over(person)
        single = _single_outlier(F.col("_z"), value, n_high, n_low)
        rows = rows.withColumn("_single", single)
        rows = _mark(rows, F.col("_single"), "Outliers_single").drop("_z", "_single")
    return rows


def _mark(rows: DataFrame, bad: Column, step: str) -> DataFrame:
    alive = F.col("drop_step") == _KEPT
    return rows.withColumn(
        "drop_step", F.when(alive & bad, STEPS.index(step)).otherwise(F.col("drop_step"))
    )


def custom_flag(df: DataFrame, lab: str, choice: str = "") -> DataFrame:
    """Add ABNORM_CUSTOM by the lab's rule, or the ordinal flag where none exists."""
    try:
        rule = thresholds.abnormal(lab, choice)
    except ValueError:
        rule = F.col("abnorm")
    return df.withColumn("abnorm_custom", rule)


SERIES = ("person_id", "sex", "event_age", "dt", "value", "abnorm", "abnorm_custom")


def clean_lab(df: DataFrame, rules: CleanRules) -> DataFrame:
    """The cleaned series of one laboratory test."""
    if rules.lab == "ogtt":
        rows = extract.flagged_only(extract.min_age(df, rules.min_age))
        rows = rows.withColumn("abnorm", recode.ordinal_flag(F.col("flag")))
    else:
        rows = annotate(df, rules).where(F.col("drop_step") == _KEPT)
    return custom_flag(rows, rules.lab, rules.choice).select(*SERIES)


def attrition(df: DataFrame, rules: CleanRules) -> DataFrame:
    """Rows and persons left and removed per cleaning step, in one pass."""
    raw = df.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("k0"),
        F.count_if(F.col("event_age") >= rules.min_age).alias("k1"),
    )
    step = F.col("drop_step")
    left = [
        F.sum("n_exact").alias("k2"),
        F.sum("n_date").alias("k3"),
        F.sum(F.when(step > 4, F.col("n_date")).otherwise(0)).alias("k4"),
        F.sum(F.when(step > 5, F.col("n_date")).otherwise(0)).alias("k5"),
        *[F.count_if(step > max(s, 5)).alias(f"k{s}") for s in range(6, _KEPT)],
    ]
    done = annotate(df, rules).groupBy("person_id").agg(*left)
    both = raw.join(done, "person_id", "left")
    totals = both.agg(
        *[F.coalesce(F.sum(f"k{s}"), F.lit(0)).alias(f"r{s}") for s in range(_KEPT)],
        *[F.count_if(F.col(f"k{s}") > 0).alias(f"p{s}") for s in range(_KEPT)],
    )
    lines = [
        F.struct(
            F.lit(s).alias("step_no"),
            F.lit(name).alias("step"),
            F.col(f"r{s}").alias("n_rows_now"),
            F.col(f"p{s}").alias("n_persons_now"),
            (F.col(f"r{max(s - 1, 0)}") - F.col(f"r{s}")).alias("n_rows_removed"),
            (F.col(f"p{max(s - 1, 0)}") - F.col(f"p{s}")).alias("n_persons_removed"),
        )
        for s, name in enumerate(STEPS)
    ]
    return totals.select(F.inline(F.array(*lines)))
