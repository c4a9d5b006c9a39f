"""Raw laboratory rows to the canonical series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: raw column names and their canonical names
RAW_NAMES = {
    "SEX": "sex",
    "EVENT_AGE": "event_age",
    "APPROX_EVENT_DATETIME": "dt",
    "MEASUREMENT_UNIT_HARMONIZED": "unit",
    "TEST_OUTCOME_IMPUTED": "flag",
}
VALUE_COLUMNS = ("MEASUREMENT_VALUE_MERGED", "MEASUREMENT_VALUE_HARMONIZED")


def lab_extract(raw: DataFrame, id_column: str = "person_id", ordered: bool = False) -> DataFrame:
    """Canonical columns; the merged value is used where the release has one."""
    value = next(c for c in VALUE_COLUMNS if c in raw.columns)
    out = raw.withColumnsRenamed({**RAW_NAMES, id_column: "person_id", value: "value"}).select(
        "person_id", "sex", "event_age", "dt", "value", "unit", "flag"
    )
    return out.orderBy(F.col("person_id").desc(), F.col("dt").desc()) if ordered else out


def allow_list(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of allowed persons; the allowed list may be of any size."""
    return df.join(allowed.select("person_id").distinct(), "person_id", "left_semi")


def min_age(df: DataFrame, years: float) -> DataFrame:
    return df.where(F.col("event_age") >= years)


def without_low_flag(df: DataFrame) -> DataFrame:
    """Rows whose flag is not L; rows without a flag are dropped too."""
    return df.where(F.col("flag") != "L")


def flagged_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("flag").isNotNull())


def main_unit(df: DataFrame, unit: str) -> DataFrame:
    return df.where(F.col("unit") == unit)


def split_rows(df: DataFrame, which: str, column: str = "split_set") -> DataFrame:
    """Rows of one set: all, train, tuning or test."""
    codes = {"train": 0.0, "tuning": 1.0, "test": 2.0}
    return df if which == "all" else df.where(F.col(column) == codes[which])


def final_training_rows(df: DataFrame, column: str = "split_set") -> DataFrame:
    """Tuning and test rows become the training rows of the final fit."""
    return df.where(F.col(column).isin(1.0, 2.0)).withColumn(column, F.lit(0.0))


def training_only(df: DataFrame, column: str = "split_set") -> DataFrame:
    return df.where(F.col(column) == 0)


def not_training(df: DataFrame, column: str = "split_set") -> DataFrame:
    return df.where(F.col(column) != 0)


def any_before(df: DataFrame, start: Column) -> DataFrame:
    """Distinct persons with an event before `start`."""
    return df.where(F.col("dt") < start).select("person_id").distinct()


def any_from(df: DataFrame, start: Column) -> DataFrame:
    """Distinct persons with an event on or after `start`."""
    return df.where(F.col("dt") >= start).select("person_id").distinct()
