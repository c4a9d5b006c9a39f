"""Ordered work on a person's series.

Inputs are cleaned or daily series (see `cleaning.daily_last`): a person has at
most a few rows per calendar day, so a window over one person is bounded by the
calendar and not by the number of raw rows. Work that needs no order is written
as an aggregation with a join back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERSON = "person_id"


def _by_date(*ties: str):
    """A person's rows by date; `ties`, what the window reads, order the rows of one day."""
    return Window.partitionBy(PERSON).orderBy("dt", *ties)


def _until_now(*ties: str):
    return _by_date(*ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _back_to_now():
    """The rows from the last one back to this one: a running frame, read in one pass."""
    backwards = Window.partitionBy(PERSON).orderBy(F.desc("dt"))
    return backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def several_rows(df: DataFrame, least: int = 2) -> DataFrame:
    """Rows of persons with at least `least` rows."""
    many = df.groupBy(PERSON).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return df.join(many.drop("_n"), PERSON, "left_semi")


def previous_flag(df: DataFrame, flag: str = "abnorm") -> DataFrame:
    """Previous flag by date, -1 where there is none."""
    return df.withColumn(
        "prev_abnorm", F.coalesce(F.lag(flag).over(_by_date(flag)), F.lit(-1.0))
    )


def abnormal_runs(series: DataFrame, flag: str = "abnorm_custom") -> DataFrame:
    """Runs of a constant flag: first date of the run and days since then.

    Persons with one row are left out before rows without a flag are. A person's
    first row always starts a run, also when its flag is -1.
    """
    rows = series.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(PERSON)))
    rows = rows.where((F.col("_n") > 1) & F.col(flag).isNotNull()).select(PERSON, "dt", flag)
    previous = F.lag(flag).over(_by_date(flag))
    starts = previous.isNull() | (F.col(flag) != previous)
    marked = rows.withColumn("_start", F.when(starts, F.col("dt")))
    return (
        marked.withColumn("start_dt", F.last("_start", ignorenulls=True).over(_until_now(flag)))
        .withColumn("diff", F.datediff("dt", "start_dt"))
        .drop("_start")
    )


def first_reaching(runs: DataFrame, days: int, flag: str = "abnorm_custom") -> DataFrame:
    """Per person the first row of the earliest abnormal run that lasts `days`."""
    lasting = runs.where((F.col(flag) >= 1) & (F.col("diff") >= days))
    first = lasting.groupBy(PERSON).agg(F.min(F.struct("start_dt", "diff", "dt", flag)).alias("_r"))
    return first.select(PERSON, "_r.*")


def data_diagnosis(series: DataFrame, days: int, flag: str = "abnorm_custom") -> DataFrame:
    """Date on which a sustained abnormal period is confirmed, and its first date."""
    return first_reaching(abnormal_runs(series, flag), days, flag).select(
        PERSON,
        F.col("dt").alias("diagnosis_dt"),
        F.col("start_dt").alias("first_abnormal_dt"),
        "diff",
    )


def _rows_on(df: DataFrame, dates: DataFrame, column: str = "dt") -> DataFrame:
    return df.join(dates, [PERSON, column], "left_semi")


def latest_rows(df: DataFrame, column: str = "dt") -> DataFrame:
    """Rows on the latest date per person; ties stay."""
    return _rows_on(df, df.groupBy(PERSON).agg(F.max(column).alias(column)), column)


def first_date_rows(df: DataFrame, column: str = "dt") -> DataFrame:
    return _rows_on(df, df.groupBy(PERSON).agg(F.min(column).alias(column)), column)


def second_dates(df: DataFrame) -> DataFrame:
    """Second distinct date per person; persons with one date are left out."""
    days = df.groupBy(PERSON, "dt").agg(F.count(F.lit(1)).alias("_n"))
    # distinct days: bounded by the calendar
    return (
        days.withColumn("_k", F.row_number().over(_by_date()))
        .where("_k = 2")
        .select(PERSON, "dt")
    )


def second_date_rows(df: DataFrame) -> DataFrame:
    return _rows_on(df, second_dates(df))


def without_any(df: DataFrame, bad: Column) -> DataFrame:
    """Rows of persons for whom `bad` holds in no row."""
    return df.join(df.where(bad).select(PERSON).distinct(), PERSON, "left_anti")


def change_from_previous(df: DataFrame, value: str = "value") -> DataFrame:
    """Sum and mean of the changes between consecutive values."""
    step = F.col(value) - F.lag(value).over(_by_date(value))
    return (
        df.where(F.col(value).isNotNull())
        .withColumn("_step", step)
        .groupBy(PERSON)
        .agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("sum_change"), F.avg("_step").alias("mean_change"))
    )


def monthly_mean(df: DataFrame, keep: Sequence[str] = ("sex",)) -> DataFrame:
    """Mean value, first attributes and the middle of the ages per month."""
    month = F.trunc("dt", "month").alias("dt")
    return df.groupBy(PERSON, month).agg(
        F.avg("value").alias("value"),
        *[F.min(c).alias(c) for c in keep],
        (F.min("event_age") + (F.max("event_age") - F.min("event_age")) / 2).alias("event_age"),
    )


def month_calendar(months: DataFrame) -> DataFrame:
    """One row per person and month between the first and the last month."""
    span = months.groupBy(PERSON).agg(F.min("dt").alias("_a"), F.max("dt").alias("_b"))
    every = F.sequence("_a", "_b", F.expr("interval 1 month"))
    return span.select(PERSON, F.explode(every).alias("dt"))


def _on_line(a: Column, b: Column, place: Column) -> Column:
    """Value at `place` between the points (`i`, `v`) before and after it."""
    share = F.try_divide(place - a["i"], b["i"] - a["i"])
    return a["v"] + (b["v"] - a["v"]) * share


def interpolate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Linear fill between known months; gaps outside stay empty."""
    place = F.year("dt") * 12 + F.month("dt")
    out = df.withColumn("_i", place)
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
        before = F.last(known, ignorenulls=True).over(_until_now())
        after = F.last(known, ignorenulls=True).over(_back_to_now())
        out = out.withColumns({f"_{c}_a": before, f"_{c}_b": after})
        filled = _on_line(F.col(f"_{c}_a"), F.col(f"_{c}_b"), F.col("_i"))
        out = out.withColumn(c, F.coalesce(F.col(c), filled)).drop(f"_{c}_a", f"_{c}_b")
    return out.drop("_i")


def filled_months(months: DataFrame, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """`interpolate` on the calendar of `month_calendar`, with `carried` attributes.

    `months` has one row per person and month, as `monthly_mean` makes them. The windows run over these rows alone; each
    row then becomes the months until the next one, so that no exchange, sort or window holds the filled calendar.
    """
    others = [c for c in months.columns if c not in (PERSON, "dt")]
    # an unknown person has a calendar, but no row meets it
    out = months.where(F.col("dt").isNotNull()).withColumns({c: F.when(F.col(PERSON).isNotNull(), F.col(c)) for c in others})
    out = carried(out, carry).withColumn("_i", F.year("dt") * 12 + F.month("dt"))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v"))) for c in columns}
    backwards = Window.partitionBy(PERSON).orderBy(F.desc("dt"))
    later = backwards.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({f"_{c}_a": F.last(k, ignorenulls=True).over(_until_now()) for c, k in known.items()})
    out = out.withColumns(
        {f"_{c}_b": F.last(k, ignorenulls=True).over(later) for c, k in known.items()} | {"_next": F.lag("_i").over(backwards)}
    )
    more = F.greatest(F.coalesce(F.col("_next") - F.col("_i") - 1, F.lit(0)), F.lit(0))
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(0), more)))
    here = F.col("_k") == 0
    cells = {}
    for c in others:
        own = F.col(c) if c in carry else F.when(here, F.col(c))
        line = _on_line(F.col(f"_{c}_a"), F.col(f"_{c}_b"), F.col("_i") + F.col("_k")) if c in columns else None
        cells[c] = own if line is None else F.coalesce(own, line)
    return out.select(PERSON, F.add_months("dt", F.col("_k")).alias("dt"), *[x.alias(c) for c, x in cells.items()])


def carried(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First known attribute of the person on every row."""
    person = Window.partitionBy(PERSON)
    return df.withColumns({c: F.min(c).over(person) for c in columns})
