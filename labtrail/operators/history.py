"""Statistics of a person's history and their imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail.functions import units
from labtrail.functions.dates import DAYS_PER_YEAR, years_between
from labtrail.operators import series as runs
from labtrail.operators.ranking import quantiles
from labtrail.operators.series import PERSON


def history_sumstats(
    series: DataFrame, labels: DataFrame, start: Column, method: str = "nearest"
) -> DataFrame:
    """The 21 statistics per labelled person and set, from values before `start`.

    One aggregation behind one exchange: the sum of consecutive changes is the last value minus the
    first, and nearest quartiles are the values at two ranks of the person's rows in the order of
    the values. That sort spills; no person's values are held as an array.
    """
    rows = series.where((F.col("dt") < start) & F.col("value").isNotNull()).join(
        labels.select(PERSON, "split_set"), PERSON
    )
    v, n = F.col("value"), F.count("value")
    points = {"QUANT_25": 0.25, "QUANT_75": 0.75}
    if method == "nearest":
        person = Window.partitionBy(PERSON, "split_set")
        rows = rows.withColumns({"_rank": F.row_number().over(person.orderBy("value")), "_n": F.count(F.lit(1)).over(person)})
        quartiles = {
            name: F.max(F.when(F.col("_rank") - 1 == F.floor((F.col("_n") - 1) * F.lit(share) + 0.5), v))
            for name, share in points.items()
        }
    else:
        quartiles = {name: F.percentile(v, share) for name, share in points.items()}
    grouped = rows.groupBy(PERSON, "split_set").agg(
        F.avg(v).alias("MEAN"),
        F.stddev_samp(v).alias("SD"),
        F.min(v).alias("MIN"),
        F.max(v).alias("MAX"),
        F.sum(v).alias("SUM"),
        F.kurtosis(v).alias("KURT"),
        F.skewness(v).alias("SKEW"),
        F.sum(v * v).alias("ABS_ENERG"),
        n.alias("SEQ_LEN"),
        F.min(F.struct("dt", "value")).alias("_first"),
        F.max(F.struct("dt", "value")).alias("_last"),
        F.min(F.struct("value", "dt")).alias("_low"),
        F.min(F.struct((-v).alias("neg"), "dt")).alias("_high"),
        F.sum("abnorm_custom").cast("long").alias("ABNORM"),
        *[q.alias(name) for name, q in quartiles.items()],
    )
    change = F.col("_last")["value"] - F.col("_first")["value"]
    return grouped.select(
        PERSON,
        "split_set",
        "MEAN",
        F.lit(0).alias("NO_HISTORY"),
        "SD",
        "MIN",
        "MAX",
        "SUM",
        "KURT",
        "SKEW",
        "ABS_ENERG",
        change.alias("SUM_CHANGE"),
        F.try_divide(change, F.col("SEQ_LEN") - 1).alias("MEAN_CHANGE"),
        "SEQ_LEN",
        "QUANT_25",
        "QUANT_75",
        F.col("_first")["value"].alias("IDX_QUANT_0"),
        F.col("_last")["value"].alias("IDX_QUANT_100"),
        "ABNORM",
        years_between(F.col("_low")["dt"], start).alias("MIN_LOC"),
        years_between(F.col("_high")["dt"], start).alias("MAX_LOC"),
        (F.datediff(F.col("_last")["dt"], F.col("_first")["dt"]) / DAYS_PER_YEAR).alias("FIRST_LAST"),
        F.col("_last")["dt"].alias("LAST_VAL_DATE"),
    )


IMPUTED_BY_MEAN = (
    "MIN",
    "MAX",
    "MEAN",
    "SUM",
    "ABS_ENERG",
    "QUANT_25",
    "QUANT_75",
    "IDX_QUANT_0",
    "IDX_QUANT_100",
    "MIN_LOC",
    "MAX_LOC",
)
SHAPE = ("KURT", "SKEW", "SD", "MEAN_CHANGE")
ZERO = ("SUM_CHANGE", "SEQ_LEN", "FIRST_LAST", "ABNORM")
# fixed value: date given to persons without history in mode 2
IMPUTED_DATE = "2013-01-01"


def mean_impute(stats: DataFrame, labels: DataFrame, mode: int = 1) -> DataFrame:
    """Add labelled persons without history, filled with training-set means.

    Mode 1 leaves the shape statistics and the last date empty, mode 2 fills
    them. The means are one aggregated row, read as a scalar.
    """
    if mode not in (1, 2):
        raise ValueError("mode is 1 or 2")
    filled = IMPUTED_BY_MEAN + (SHAPE if mode == 2 else ())
    means = (
        stats.where(F.col("split_set") == 0)
        .agg(F.struct(*[F.avg(c).alias(c) for c in filled]).alias("m"))
        .scalar()
    )
    missing = labels.select(PERSON, "split_set").join(stats.select(PERSON), PERSON, "left_anti")
    missing = missing.withColumn("_m", means)
    types = {f.name: f.dataType for f in stats.schema}

    def cell(name: str) -> Column:
        if name in (PERSON, "split_set"):
            return F.col(name)
        if name == "NO_HISTORY":
            value = F.lit(1)
        elif name in filled:
            value = F.col("_m")[name]
        elif name in ZERO:
            value = F.lit(0)
        elif name == "LAST_VAL_DATE" and mode == 2:
            value = F.lit(IMPUTED_DATE)
        else:
            value = F.lit(None)
        return value.cast(types[name]).alias(name)

    return stats.unionByName(missing.select(*[cell(c) for c in stats.columns]))


def days_since_last(stats: DataFrame, start: Column) -> DataFrame:
    return stats.withColumn("LAST_VAL_DIFF", F.datediff(start, "LAST_VAL_DATE"))


def monthly_interpolated(series: DataFrame, start: Column) -> DataFrame:
    """Monthly creatinine filled between known months, as rate with flag."""
    months = runs.monthly_mean(series.where((F.col("dt") < start) & F.col("value").isNotNull()))
    full = runs.filled_months(months, ["value", "event_age"], ["sex"])
    rate = units.egfr_2021(F.col("value"), F.col("sex"), F.col("event_age"))
    return full.withColumn("value", rate).withColumn(
        "abnorm_custom", F.when(F.col("value") < 60, 1.0).otherwise(0.0)
    )


def lab_features(labs: DataFrame, method: str = "nearest") -> DataFrame:
    """Mean and quartiles per person and lab, in long form.

    All come from counts of distinct values in one pass, so raw rows of one
    person and lab are combined before they meet in a task.
    """
    points = {"QUANT25": 0.25, "QUANT75": 0.75}
    return quantiles(labs, [PERSON, "lab"], "value", points, method, mean="MEAN")


def lab_matrix(features: DataFrame, labs: Sequence[str]) -> DataFrame:
    """One column `<lab>_<STAT>` per lab and statistic."""
    wide = features.groupBy(PERSON).pivot("lab", list(labs))
    stats = ("MEAN", "QUANT25", "QUANT75")
    return wide.agg(*[F.max(s).alias(s) for s in stats])


def replace_labs(labs: DataFrame, derived: DataFrame, replaced: Sequence[str], name: str) -> DataFrame:
    """Drop the listed labs and add one derived series under `name`."""
    kept = labs.where(~F.col("lab").isin(*replaced)).select(PERSON, "value", "dt", "lab")
    return kept.unionByName(derived.select(PERSON, "value", "dt", F.lit(name).alias("lab")))
