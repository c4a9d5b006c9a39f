"""Person covariates: smoking, blood pressure, education, body mass, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.functions import dates, recode
from labtrail.operators.series import PERSON, latest_rows


def smoke_latest(rows: DataFrame, start: Column, status: str = "status") -> DataFrame:
    """Smoking class on the latest date before `start`; the highest if dates tie."""
    coded = rows.withColumn("smoke", recode.smoking_status(F.col(status)))
    known = coded.where(F.col("smoke").isNotNull() & (F.col("dt") < start))
    return _on_latest(known, F.max("smoke").alias("smoke"))


def _on_latest(rows: DataFrame, *stats: Column) -> DataFrame:
    return latest_rows(rows).groupBy(PERSON).agg(*stats)


def latest_mean(rows: DataFrame, start: Column, value: str, name: str) -> DataFrame:
    """Mean of a measure on the person's latest date before `start`."""
    known = rows.where(F.col(value).isNotNull() & (F.col("dt") < start))
    return _on_latest(known, F.avg(value).alias(name))


def latest_status(rows: DataFrame, start: Column, value: str, name: str) -> DataFrame:
    """Highest status on the person's latest date before `start`."""
    known = rows.where(F.col(value).isNotNull() & (F.col("dt") < start))
    return _on_latest(known, F.max(value).alias(name))


def edu_max(rows: DataFrame, year: int, code: str = "code") -> DataFrame:
    """Education class from the highest level reached up to a year."""
    level = recode.education_level(F.col(code))
    top = rows.where(F.year("dt") <= year).groupBy(PERSON).agg(F.max(level).alias("_level"))
    return top.where(F.col("_level").isNotNull()).select(
        PERSON, recode.education_binary(F.col("_level")).alias("edu")
    )


def bmi_with_fallback(visits: DataFrame, persons: DataFrame, start: Column) -> DataFrame:
    """Body mass from visits before `start`, else from the person register.

    `persons` has birth_date, bmi and weight_age; the register value is dated by
    the age at weighing, or one year before `start` where that is unknown.
    """
    measured = latest_mean(visits, start, "value", "bmi")
    dated = dates.date_at_age(F.col("birth_date"), F.col("weight_age"), start)
    register = (
        persons.where(F.col("bmi").isNotNull() & (dated < start))
        .select(PERSON, "bmi")
        .join(measured.select(PERSON), PERSON, "left_anti")
    )
    return measured.unionByName(register)


def covariate_fill(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float(v))) for c, v in defaults.items()})


# fixed values: what a missing covariate is set to on request
MISSING_COVARIATES = {"bmi": 22.0, "edu": 0.5}


def read_score(table: DataFrame, name: str) -> DataFrame:
    """Score table with two columns (id, score) or five (.., id, .., .., score)."""
    if len(table.columns) not in (2, 5):
        raise ValueError("a score table has two or five columns")
    id_column = table.columns[0] if len(table.columns) == 2 else table.columns[1]
    return table.select(F.col(id_column).alias(PERSON), F.col(table.columns[-1]).alias(name))


def pcs_required(df: DataFrame, components: DataFrame) -> DataFrame:
    """Attach genetic components and keep the persons who have them."""
    return df.join(components.where(F.col("pc1").isNotNull()), PERSON)


def pgs_attach(df: DataFrame, scores: dict[str, DataFrame], components: DataFrame) -> DataFrame:
    """Left join each score, then require the genetic components."""
    for name, table in scores.items():
        df = df.join(read_score(table, name), PERSON, "left")
    return pcs_required(df, components)
