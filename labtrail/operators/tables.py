"""Count tables, case-control tables and reshapes of results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labtrail.session import stage


def person_row_count(df: DataFrame) -> DataFrame:
    """Distinct persons and rows; rows are reduced per person first."""
    per = df.groupBy("person_id").agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n_persons"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of rows per value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def case_control_continuous(
    df: DataFrame, keys: Sequence[str], variables: Mapping[str, str], outcomes: Mapping[str, str]
) -> DataFrame:
    """N, missing, mean and SD per variable and outcome for all, cases and controls."""
    values = [
        F.struct(F.lit(n).alias("variable"), F.col(c).cast("double").alias("value"))
        for n, c in variables.items()
    ]
    goals = [F.struct(F.lit(n).alias("outcome"), F.col(c).alias("label")) for n, c in outcomes.items()]
    long = df.select(*keys, F.array(*goals).alias("_g"), F.inline(F.array(*values)))
    long = long.select(*keys, "variable", "value", F.inline("_g"))
    stats = []
    for name, test in (("all", F.lit(True)), ("cases", F.col("label") == 1), ("controls", F.col("label") == 0)):
        value = F.when(test, F.col("value"))
        stats += [
            F.count_if(test).alias("n_total" if name == "all" else f"n_{name}"),
            F.count_if(test & F.col("value").isNull()).alias(
                "n_missing" if name == "all" else f"n_missing_{name}"
            ),
            F.avg(value).alias(f"{name}_mean"),
            F.stddev_samp(value).alias(f"{name}_sd"),
        ]
    return long.groupBy(*keys, "variable", "outcome").agg(*stats)


def case_control_binary(
    df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column], outcomes: Mapping[str, str]
) -> DataFrame:
    """Cases and controls with and without each condition, per outcome."""
    tests = [
        F.struct(F.lit(n).alias("condition"), F.coalesce(c, F.lit(False)).alias("hit"))
        for n, c in conditions.items()
    ]
    goals = [F.struct(F.lit(n).alias("outcome"), F.col(c).alias("label")) for n, c in outcomes.items()]
    long = df.select(*keys, F.array(*goals).alias("_g"), F.inline(F.array(*tests)))
    long = long.select(*keys, "condition", "hit", F.inline("_g"))
    case, control = F.col("label") == 1, F.col("label") == 0
    return long.groupBy(*keys, "condition", "outcome").agg(
        F.count_if(case).alias("n_cases"),
        F.count_if(control).alias("n_controls"),
        F.count_if(case & F.col("hit")).alias("cases_prior"),
        F.count_if(control & F.col("hit")).alias("controls_prior"),
    )


def long_to_columns(
    df: DataFrame, keys: Sequence[str], name: str, values: Sequence[str], value: str
) -> DataFrame:
    """Name/value rows to columns, with a fixed list of names."""
    return df.groupBy(*keys).pivot(name, list(values)).agg(F.max(value))


# fixed values: count columns and what they count
COUNT_TYPES = {
    "n_case": ("Diagnosis (30 days)", "Case"),
    "n_control": ("Diagnosis (30 days)", "Control"),
    "n_case_icd": ("Diagnosis (ICD)", "Case"),
    "n_case_90": ("Diagnosis (90 days)", "Case"),
    "n_control_90": ("Diagnosis (90 days)", "Control"),
    "n_mean_abnormal": ("Mean abnormal", "Case"),
    "n_mean_normal": ("Mean abnormal", "Control"),
    "n_min_abnormal": ("Min abnormal", "Case"),
    "n_min_normal": ("Min abnormal", "Control"),
}


def pivot_status(counts: DataFrame) -> DataFrame:
    """Yearly count columns to (year, type, case, control)."""
    used = [c for c in COUNT_TYPES if c in counts.columns]
    lines = [
        F.struct(
            F.lit(COUNT_TYPES[c][0]).alias("type"),
            F.lit(COUNT_TYPES[c][1]).alias("status"),
            F.col(c).alias("n"),
        )
        for c in used
    ]
    long = counts.select("year", F.inline(F.array(*lines)))
    wide = long_to_columns(long, ["year", "type"], "status", ["Case", "Control"], "n")
    return wide.withColumnsRenamed({"Case": "n_case", "Control": "n_control"})


def case_share(status: DataFrame) -> DataFrame:
    return status.withColumn(
        "share", F.try_divide(F.col("n_case"), F.col("n_case") + F.col("n_control"))
    )


def year_mean_gap(status: DataFrame, kind: str, other: str, since: int) -> DataFrame:
    """Mean yearly cases of one definition and mean yearly gap to another."""

    def of(name: str) -> Column:
        return F.sum(F.when(F.col("type") == name, F.col("n_case")))

    per_year = status.where(F.col("year") >= since).groupBy("year").agg(
        of(kind).alias("a"), of(other).alias("b")
    )
    return per_year.agg(F.avg("a").alias("mean_cases"), F.avg(F.col("a") - F.col("b")).alias("mean_gap"))


def mean_sd_across(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and SD of a result over labs, joined back to every row."""
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_sd")
    )
    return df.join(stats, list(keys))


def stack_labs(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row-bind result tables with a lab column."""
    out = None
    for name, table in tables.items():
        part = table.withColumn("lab", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def fallback_rows(df: DataFrame, wanted: Sequence[str], source: str = "all data") -> DataFrame:
    """Where a lab misses a predictor set, its baseline row of `source` stands in."""
    out = df
    for name in wanted:
        has = df.where(F.col("predictors") == name).select("lab").distinct()
        copy = (
            df.where((F.col("model_1") == "baseline") & (F.col("predictors") == source))
            .join(has, "lab", "left_anti")
            .withColumn("predictors", F.lit(name))
        )
        out = out.unionByName(copy)
    return out.distinct()


def stack_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AUC and average precision as rows with common interval columns."""
    lines = [
        F.struct(
            F.lit(label).alias("type"),
            F.col(c).alias("value"),
            F.col(f"{c}_low").alias("low"),
            F.col(f"{c}_high").alias("high"),
        )
        for label, c in (("AUC", "auc"), ("Average Precision", "avg_prec"))
    ]
    return df.select(*keys, F.inline(F.array(*lines)))


def unpivot_goals(df: DataFrame, key: str, groups: Sequence[str], goals: Sequence[str]) -> DataFrame:
    """Percent text columns to (group, goal, percent) rows of the listed groups and goals."""
    from labtrail.functions.texts import percent_number

    others = [c for c in df.columns if c != key]
    numbers = df.withColumns({c: percent_number(F.col(c).cast("string")) for c in others})
    long = numbers.unpivot([key], others, "goal", "pct")
    return long.where(F.col(key).isin(*groups) & F.col("goal").isin(*goals))


def top_rows(df: DataFrame, order: Sequence[Column], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def ranked_rows(df: DataFrame, order: Sequence[Column], place: str = "place") -> DataFrame:
    """Add each row's place, from 1, in the order of the whole table, which must be a total one.

    Rows are sorted by ranges; only the ranges' sizes meet in one task.
    """
    by_range = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stage(by_range.withColumn("_id", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_id", 33))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), "_range").withColumn(place, F.col("_start") + inside + 1).drop("_id", "_range", "_start")


def last_per_code(df: DataFrame, code: str, n: str, keep: str) -> DataFrame:
    """The entry with most rows per code; the later name if counts tie."""
    best = F.max(F.struct(n, keep))
    return df.groupBy(code).agg(best.alias("_b")).select(code, "_b.*")


