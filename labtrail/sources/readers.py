"""Readers for the file layouts the analyses start from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_file(
    spark: SparkSession, path: str, schema: Mapping[str, str] | None = None
) -> DataFrame:
    """CSV ("NA" is null, dates parsed, optional type overrides) or Parquet."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if not path.endswith(".csv"):
        raise ValueError(f"file type not supported: {path}")
    options = {"header": True, "nullValue": "NA", "dateFormat": "yyyy-MM-dd"}
    header = spark.read.options(**options).csv(path).schema
    given = dict(schema or {})
    if set(header.names) - set(given):
        # a further pass over the file, only where some types are not given
        header = spark.read.options(**options, inferSchema=True).csv(path).schema
    types = ", ".join(f"`{f.name}` {given.get(f.name, f.dataType.simpleString())}" for f in header)
    return spark.read.options(**options).schema(types).csv(path)


def read_delimited(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    sep: str = "\t",
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Project columns of a delimited text file (gz allowed) and rename some."""
    table = spark.read.options(header=True, sep=sep, nullValue="NA").csv(path)
    return table.select(*columns).withColumnsRenamed(dict(rename or {}))


def typed_key(df: DataFrame, column: str, key: str | int) -> Column:
    """Equality that casts the literal, not the column, so that it is pushed down."""
    return F.col(column) == F.lit(key).cast(df.schema[column].dataType)


def select_code(
    df: DataFrame,
    column: str,
    key: str | int,
    columns: Sequence[str],
    unit_column: str | None = None,
    unit: str = "NA",
) -> DataFrame:
    """Rows of one lab or code; `unit` "NA" means any unit."""
    rows = df.where(typed_key(df, column, key))
    if unit_column is not None and unit != "NA":
        rows = rows.where(F.col(unit_column) == unit)
    return rows.select(*columns)


CODE_SHAPE = "^[A-Z][0-9]"
PROCEDURE_CATEGORY = "^(ICP|OP|MOP)"
VISIT_SOURCES = ("INPAT", "OUTPAT", "PRIM_OUT")


def _not_procedure() -> Column:
    category = F.col("category")
    return ~category.rlike(PROCEDURE_CATEGORY) & (category != "None")


def diagnosis_and_drug_rows(
    register: DataFrame, diagnosis: str = "", drug: str = ""
) -> DataFrame:
    """Diagnosis rows matching one regex or drug purchases matching another."""
    if not diagnosis and not drug:
        raise ValueError("give a diagnosis regex, a drug regex or both")
    keep = F.lit(False)
    if diagnosis:
        second = F.col("source").isin(*VISIT_SOURCES, "REIMB") & F.col("code2").rlike(diagnosis)
        first = F.col("source").isin(*VISIT_SOURCES) & F.col("code1").rlike(diagnosis)
        keep = keep | ((second | first) & _not_procedure())
    if drug:
        keep = keep | ((F.col("source") == "PURCH") & F.col("code1").rlike(drug))
    return register.where(keep).select("person_id", "source", "event_age", "dt", "code1", "code2")


EVENT_COLUMNS = ("person_id", "event_age", "dt", "code", "category", "icdver", "source")


def death_codes(register: DataFrame) -> DataFrame:
    named = (F.col("source") == "DEATH") & (F.col("code1") != "None")
    return (
        register.where(named & F.col("code1").rlike(CODE_SHAPE))
        .withColumn("code", F.col("code1"))
        .select(*EVENT_COLUMNS)
    )


def visit_codes(register: DataFrame) -> DataFrame:
    """Both code columns of in-patient, out-patient and primary care visits as rows."""
    shaped = F.col("code1").rlike(CODE_SHAPE) | F.col("code2").rlike(CODE_SHAPE)
    kept = register.where(F.col("source").isin(*VISIT_SOURCES) & shaped & _not_procedure())
    return (
        kept.select(
            "person_id",
            "event_age",
            "dt",
            F.explode(F.array("code1", "code2")).alias("code"),
            "category",
            "icdver",
            "source",
        )
        .where(F.col("code").rlike(CODE_SHAPE))
        .distinct()
    )


def reimbursement_codes(register: DataFrame) -> DataFrame:
    named = (F.col("source") == "REIMB") & (F.col("code2") != "None")
    return (
        register.where(named & F.col("code2").rlike(CODE_SHAPE))
        .withColumn("code", F.col("code2"))
        .withColumn("category", F.lit("1"))
        .select(*EVENT_COLUMNS)
    )


def drug_purchases(register: DataFrame) -> DataFrame:
    return (
        register.where((F.col("source") == "PURCH") & (F.col("code1") != "NA"))
        .select("person_id", "event_age", "dt", F.col("code1").alias("code"))
        .distinct()
    )


def operations(register: DataFrame, regex: str) -> DataFrame:
    """Operations whose code starts with `regex`."""
    return register.where(
        F.col("source").rlike("^(OPER_IN|OPER_OUT)") & F.col("code1").rlike(f"^(?:{regex})")
    ).select("person_id", "event_age", "dt", F.col("code1").alias("code"))


def end_of_follow_up(persons: DataFrame, age: str = "follow_up_age") -> DataFrame:
    """Date at which the follow-up ends: birth date plus the age in days."""
    days = F.floor(F.col(age) * 365.25).cast("int")
    return persons.withColumn("end_of_follow_up", F.date_add("birth_date", days))


def parse_datetime_columns(df: DataFrame, suffix: str = "_DATETIME") -> DataFrame:
    """Parse every text column whose name ends with `suffix`."""
    stamp = F.lit("yyyy-MM-dd HH:mm:ss")
    return df.withColumns(
        {c: F.try_to_timestamp(F.col(c), stamp) for c in df.columns if c.endswith(suffix)}
    )


def latest_run(df: DataFrame, column: str = "run_date") -> DataFrame:
    """Rows of the newest dated run; prunes partitions when `column` is one."""
    newest = df.agg(F.max(column).alias("newest"))
    return df.where(F.col(column) == newest.scalar())
