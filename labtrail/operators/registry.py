"""Registry codes: row rules, prevalence, long counts and matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WELL_FORMED = "^[A-Z][0-9]"


def row_rules(register: DataFrame) -> DataFrame:
    """Diagnosis rows of the detailed register, one row per kept code."""
    version = F.col("icdver").rlike("^(10|NA)")
    source = F.col("source").rlike("^(INPAT|OUTPAT|PRIM_OUT|REIMB|DEATH)")
    kept = register.where(~F.col("category").rlike("^(ICP|OP|MOP)") & version & source)
    first = F.when(F.col("code1").rlike(WELL_FORMED), F.col("code1"))
    other = F.col("code2").rlike(WELL_FORMED) & ~F.col("code2").eqNullSafe(F.col("code1"))
    second = F.when(other, F.col("code2"))
    return (
        kept.withColumn("code", F.explode(F.array(first, second)))
        .where(F.col("code").isNotNull())
        .select(
            "person_id",
            "event_age",
            "dt",
            "code",
            "category",
            "icdver",
            "source",
            code_prefix(F.col("code"), 3).alias("code_three"),
        )
    )


def code_prefix(code: Column, length: int) -> Column:
    """Three characters name a diagnosis group, five a drug group."""
    return F.substring(code, 1, length)


def matching(events: DataFrame, regex: str, column: str = "code") -> DataFrame:
    return events.where(F.col(column).rlike(regex))


def unpivot_codes(
    rows: DataFrame, ids: Sequence[str], codes: Sequence[str], name: str = "code"
) -> DataFrame:
    """Code columns as distinct, well-formed rows."""
    long = rows.unpivot(list(ids), list(codes), "_column", name).drop("_column")
    return long.where(F.col(name).isNotNull() & F.col(name).rlike(WELL_FORMED)).distinct()


def unpivot_register(rows: DataFrame, treatment: str, below: int = 52) -> DataFrame:
    """Kidney register rows of dialysis or transplant as code events."""
    kept = rows.where(F.col(treatment).try_cast("int") < below).where(F.col("event_age").isNotNull())
    return kept.unpivot(["person_id", "event_age", "dt"], [treatment], "_column", "code").drop(
        "_column"
    )


def history_window(events: DataFrame, start: Column, start_year: int | None = None) -> DataFrame:
    """Events before `start` and, if given, not before `start_year`."""
    rows = events.where(F.col("dt") < start)
    return rows.where(F.year("dt") >= start_year) if start_year else rows


def prevalence(
    events: DataFrame,
    persons: DataFrame,
    column: str,
    min_age: int = 18,
    max_age: int = 70,
) -> DataFrame:
    """Entries, persons and share of all persons per code.

    Rows are first reduced to (code, person), so that a code or a person with
    very many rows is combined before the second exchange.
    """
    total = persons.agg(F.countDistinct("person_id").alias("n"))
    pairs = (
        events.where(F.col("event_age").between(min_age, max_age))
        .groupBy(column, "person_id")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    return pairs.groupBy(column).agg(
        F.sum("k").alias("n_entry"), F.count(F.lit(1)).alias("n_person")
    ).withColumn("share", F.col("n_person") / total.scalar())


def frequent_events(
    events: DataFrame,
    persons: DataFrame,
    column: str,
    min_share: float,
    min_age: int = 18,
    max_age: int = 70,
    limit_rows: bool = False,
) -> DataFrame:
    """Event rows of codes carried by at least `min_share` of all persons.

    Ages limit the prevalence; `limit_rows` applies them to the rows as well.
    """
    keep = prevalence(events, persons, column, min_age, max_age).where(F.col("share") >= min_share)
    rows = events.where(F.col("event_age").between(min_age, max_age)) if limit_rows else events
    return rows.join(keep.select(column), column, "left_semi")


def code_counts(events: DataFrame, column: str, binary: bool = False) -> DataFrame:
    """Long form of the code matrix: (person, code, n)."""
    out = events.groupBy("person_id", column).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("n", F.lit(1).cast("long")) if binary else out


def rare_code_drop(counts: DataFrame, cohort: DataFrame, column: str, least: int = 5) -> DataFrame:
    """Long counts of cohort members without codes whose cohort sum is below `least`."""
    members = counts.join(cohort.select("person_id").distinct(), "person_id", "left_semi")
    keep = members.groupBy(column).agg(F.sum("n").alias("s")).where(F.col("s") >= least)
    return members.join(keep.select(column), column, "left_semi")


def code_matrix(
    counts: DataFrame, persons: DataFrame, column: str, codes: Sequence[str]
) -> DataFrame:
    """One column per code and one row per person of `persons` or `counts`; absent is 0.

    `codes` is the sorted value list of an earlier prevalence query, so the
    schema is stable and no extra job looks for it.
    """
    codes = list(codes)
    number = T.StructType([T.StructField("_place", T.IntegerType()), T.StructField(column, counts.schema[column].dataType)])
    places = F.broadcast(counts.sparkSession.createDataFrame(list(enumerate(codes)), number))  # at most a schema's size
    # groups, exchanges and the join carry a person's own codes; a row gets its width after them
    each = counts.join(places, column, "left").groupBy("person_id", column, "_place").agg(F.sum("n").alias("_n"))
    own = F.when(F.col("_place").isNotNull(), F.struct("_place", "_n"))
    lines = each.groupBy("person_id").agg(F.sort_array(F.collect_list(own)).alias("_own"))
    zero = F.lit(0).cast(each.schema["_n"].dataType)

    def filled(entry: Column, k: Column) -> Column:
        before = F.coalesce(F.get("_own", k - 1)["_place"], F.lit(-1))
        return F.concat(F.array_repeat(zero, entry["_place"] - before - 1), F.array(entry["_n"]))

    last = F.coalesce(F.get("_own", F.size("_own") - 1)["_place"], F.lit(-1))
    every = F.concat(F.flatten(F.transform("_own", filled)), F.array_repeat(zero, F.lit(len(codes) - 1) - last))
    spine = persons.select("person_id").distinct()
    # who has no codes gets zeros below
    wide = spine.join(lines, "person_id", "full").withColumn("_all", every)
    return wide.select("person_id", *[F.get("_all", F.lit(k)).alias(c) for k, c in enumerate(codes)]).fillna(0, subset=codes)


def frequent_code_matrix(
    events: DataFrame, history: DataFrame, persons: DataFrame, column: str, min_share: float, min_age: int = 18, max_age: int = 70
) -> tuple[DataFrame, list[str]]:
    """The code matrix of `history` over the codes that at least `min_share` of all persons have in `events`,
    and these codes in order: a list of at most a schema's size."""
    found = prevalence(events, persons, column, min_age, max_age).where(F.col("share") >= min_share)
    codes = sorted(r[0] for r in found.where(F.col(column).isNotNull()).select(column).collect())
    if not codes:
        return persons.select("person_id").distinct(), codes
    counts = code_counts(history.where(F.col(column).isin(codes)), column)
    return code_matrix(counts, persons, column, codes), codes


def person_code_totals(counts: DataFrame, persons: DataFrame) -> DataFrame:
    """Number of code entries per person; none is null."""
    total = counts.groupBy("person_id").agg(F.sum("n").alias("n_codes"))
    return persons.select("person_id").join(total, "person_id", "left").withColumn(
        "n_codes", F.nullif("n_codes", F.lit(0))
    )


def counts_in_two_cohorts(
    events: DataFrame, first: DataFrame, second: DataFrame, column: str, least: int = 5
) -> DataFrame:
    """Distinct persons per code in two cohorts; codes with `least` in both."""

    def one(cohort: DataFrame, name: str) -> DataFrame:
        pairs = (
            events.join(cohort.select("person_id"), "person_id", "left_semi")
            .select("person_id", column)
            .distinct()
        )
        return pairs.groupBy(column).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) >= least)

    return one(first, "n_first").join(one(second, "n_second"), column)


def first_code_date(events: DataFrame, regex: str) -> DataFrame:
    """First date per person and code among matching events."""
    return matching(events, regex).groupBy("person_id", "code").agg(F.min("dt").alias("dt"))
