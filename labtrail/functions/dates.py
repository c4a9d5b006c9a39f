"""Ages, date parsing and distances."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def day(text: str | datetime.date) -> Column:
    return F.lit(str(text)).cast("date")


def age_at(date: Column, birth: Column) -> Column:
    """Completed years as floor(days / 365.25)."""
    return F.floor(F.datediff(date, birth) / DAYS_PER_YEAR)


def years_between(first: Column, second: Column) -> Column:
    return F.abs(F.datediff(first, second)) / DAYS_PER_YEAR


def parse_date(text: Column) -> Column:
    """Date from "date time" text, from date text, otherwise null."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
    ).cast("date")


def months_back(date: Column, months: int) -> Column:
    return F.add_months(date, -months)


def date_at_age(birth: Column, age: Column, start: Column) -> Column:
    """Birth date plus the age in days; without an age, one year before `start`."""
    dated = F.date_add(birth, F.round(age * DAYS_PER_YEAR).cast("int"))
    default = F.date_sub(start, int(DAYS_PER_YEAR))
    return F.when(age.isNotNull(), dated).otherwise(default)
