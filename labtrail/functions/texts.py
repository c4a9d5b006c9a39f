"""Readable names and result texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.functions.recode import lookup

# fixed values: display names of laboratory tests
LAB_NAMES = {"hba1c": "HbA1c", "egfr": "eGFR", "ana": "ANA", "tsh": "TSH", "ldl": "LDL"}
SECOND_LAB_NAMES = {
    "ftri": "Fasting TG",
    "t4": "fT4",
    "cystc": "Cystatin C",
    "fgluc": "Fasting Glucose",
}
# fixed values: display names of plain columns and of statistics of one lab
COLUMN_NAMES = {"EVENT_AGE": "Age", "SEX": "Sex", "YEAR": "Year"}
STATISTIC_NAMES = {
    "MIN": "Min",
    "MEAN": "Mean",
    "MAX": "Max",
    "MEDIAN": "Median",
    "LAST_VAL_DIFF": "Distance of last value",
    "IDX_QUANT_100": "Last value",
    "IDX_QUANT_50": "Mid value",
    "IDX_QUANT_0": "First value",
    "FIRST_LAST": "Days between first and last",
    "MIN_LOC": "Location of min (-days)",
    "MAX_LOC": "Location of max (-days)",
    "REG_COEF": "Regression coef",
    "SUM_ABS_CHANGE": "Sum of absolute change",
    "MAX_ABS_CHANGE": "Max of absolute change",
    "MEAN_ABS_CHANGE": "Mean of absolute change",
    "ABNORM": "Number of prior abnorm",
    "MEAN_CHANGE": "Mean change",
    "MAX_CHANGE": "Max change",
    "SUM": "Sum",
    "SD": "Standard deviation",
    "ABS_ENERG": "Absolute energy",
    "SKEW": "Skew",
    "KURT": "Kurtosis",
    "SEQ_LEN": "Number of measurements",
    "SUM_CHANGE": "Sum of change",
}


def pretty_count(n: Column) -> Column:
    """532, 1K, 1.2M."""
    millions = F.concat(F.round(n / 1e6, 2).cast("string"), F.lit("M"))
    thousands = F.concat(F.bround(n / 1e3, 0).cast("long").cast("string"), F.lit("K"))
    return F.when(n >= 1_000_000, millions).when(n >= 1000, thousands).otherwise(n.cast("string"))


def percent(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.try_divide(part, whole) * 100, digits)


def mean_sd_text(mean: Column, sd: Column, missing: Column, total: Column) -> Column:
    """Text such as "12.3 ± 4.56 (7.89%)"."""
    return F.concat(
        F.round(mean, 2).cast("string"),
        F.lit(" ± "),
        F.round(sd, 2).cast("string"),
        F.lit(" ("),
        percent(missing, total, 2).cast("string"),
        F.lit("%)"),
    )


def share_text(part: Column, total: Column) -> Column:
    """Text such as "12.3% (N=45)"."""
    return F.concat(
        percent(part, total, 1).cast("string"), F.lit("% (N="), part.cast("string"), F.lit(")")
    )


def percent_number(text: Column) -> Column:
    """Number in front of a percent sign; null where there is none."""
    return F.regexp_replace(text, "%", "").try_cast("double")


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def feature_labels(
    features: DataFrame, concepts: DataFrame, lab: str, second_lab: str = ""
) -> DataFrame:
    """Add `label` to a table with a `feature` column.

    `concepts` maps `concept_id` to `concept_name`; features of a concept are
    named `<concept_id>_<STATISTIC>`. A leading S_ marks the second lab.
    """
    first_name = LAB_NAMES.get(lab, lab)
    second_name = SECOND_LAB_NAMES.get(second_lab, second_lab)
    second = F.col("feature").startswith("S_")
    named = features.withColumns(
        {
            "_bare": F.when(second, F.substr("feature", F.lit(3))).otherwise(F.col("feature")),
            "_lab": F.when(second, second_name).otherwise(first_name),
        }
    )
    named = named.withColumn("_part", F.split("_bare", "_")).join(
        concepts.select(
            F.col("concept_id").alias("_id"), F.col("concept_name").alias("_concept")
        ),
        F.col("_part")[0] == F.col("_id"),
        "left",
    )
    statistic = F.get(F.col("_part"), F.lit(1))
    before = F.split("_concept", r"\[")[0]
    after = F.coalesce(F.get(F.split("_concept", r"\]"), F.lit(1)), F.lit(""))
    quantile = F.col("_bare").contains("QUANT")
    of_concept = F.concat(
        F.when(quantile, F.concat(F.regexp_replace(statistic, "QUANT", ""), F.lit("% Quant")))
        .otherwise(_capital(statistic)),
        F.lit(" - "),
        before,
        after,
    )
    of_lab = F.concat(
        F.when(
            F.col("_bare").startswith("QUANT"), F.concat(statistic, F.lit("% Quant"))
        ).otherwise(lookup(F.col("_bare"), STATISTIC_NAMES)),
        F.lit(" - "),
        F.col("_lab"),
    )
    label = F.coalesce(of_concept, of_lab, lookup(F.col("_bare"), COLUMN_NAMES), F.col("_bare"))
    return named.withColumn("label", label).drop("_bare", "_lab", "_part", "_id", "_concept")


def signed_bounds(estimate: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Interval bounds, exchanged where the estimate is negative."""
    negative = estimate < 0
    return F.when(negative, high).otherwise(low), F.when(negative, low).otherwise(high)
