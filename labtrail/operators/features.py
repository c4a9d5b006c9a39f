"""Assembly of the wide feature table and of person filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.functions import recode
from labtrail.operators import schema
from labtrail.operators.ranking import quantiles
from labtrail.operators.series import PERSON
from labtrail.session import stage


def join_features(labels: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """Labels LEFT JOIN every feature table on the person.

    All joins share the person key, so the label side is exchanged once.
    """
    out = labels
    for part in parts:
        out = out.join(part, PERSON, "left")
    return out


def feature_matrix(
    labels: DataFrame,
    parts: Sequence[DataFrame],
    features: Sequence[str],
    needed: Sequence[str] = (),
    defaults: Mapping[str, float] | None = None,
) -> DataFrame:
    """Labels and all features with narrowed types and no repeated rows."""
    wide = join_features(labels, parts)
    if defaults:
        wide = wide.fillna(dict(defaults))
    text = dict(wide.dtypes)["sex"] == "string"
    # the types are looked up in one job and the rows read in another: join once
    wide = stage(wide.withColumn("sex", recode.sex_binary(F.col("sex"), text)))
    return schema.ensure_columns(schema.narrow_types(wide, list(features)), needed)


def history_spread(series: DataFrame) -> DataFrame:
    """Variance, count, last date and ever-abnormal flag per person."""
    return series.groupBy(PERSON).agg(
        F.var_samp("value").alias("variance"),
        F.count(F.lit(1)).alias("n"),
        F.max("dt").alias("last_dt"),
        F.bool_or(F.col("abnorm_custom") == 1).alias("ever_abnormal"),
    )


def variance_tertiles(spread: DataFrame) -> DataFrame:
    """Low, middle and high groups of variance and count, cut at 33 and 67 percent.

    `spread` has one row per person. It is read three times (two cut points and
    the rows), so it is staged once.
    """
    points = {"low": 0.33, "high": 0.67}
    stats = stage(spread)
    rows = stats
    for c in ("variance", "n"):
        cuts = quantiles(stats.select(F.col(c).cast("double").alias(c)), [], c, points)
        rows = rows.withColumn(f"_{c}", cuts.select(F.struct("low", "high").alias("c")).scalar())
    v, n = F.col("variance"), F.col("n")
    vc, nc = F.col("_variance"), F.col("_n")
    return rows.withColumns(
        {
            "variance_group": F.when(v <= vc["low"], "Low var")
            .when(v >= vc["high"], "High var")
            .when(v.isNotNull(), "Mid var"),
            "n_group": F.when(n < nc["low"], "Low N").when(n > nc["high"], "High N").otherwise("Mid N"),
        }
    ).drop("_variance", "_n")


def subgroups(labels: DataFrame, history: DataFrame, last_before: Column) -> DataFrame:
    """(person, filter) rows of the named person filters.

    `labels` has the age at the base date, `history` the cleaned rows before it.
    """
    rows = labels.join(variance_tertiles(history_spread(history)), PERSON, "left")
    none = F.col("last_dt").isNull()
    late = F.coalesce(F.col("last_dt") < last_before, F.lit(False))
    normal = ~F.coalesce(F.col("ever_abnormal"), F.lit(False))
    names = F.array(
        F.lit("All"),
        F.when(~none, "History"),
        F.when(none, "No history"),
        F.when(none | normal, "All normal | No history"),
        F.when(late | none, "Last long ago | No history"),
        F.when(late, "Last long ago"),
        F.col("variance_group"),
        F.col("n_group"),
        recode.age_band(F.col("event_age")),
    )
    return rows.select(PERSON, F.explode(F.array_compact(names)).alias("filter"))


def case_control_features(
    labels: DataFrame,
    counts: Mapping[str, DataFrame],
    series: Mapping[str, DataFrame],
    covariates: Sequence[DataFrame],
    base: Column,
) -> DataFrame:
    """Code counts, latest values, ever-abnormal flags and covariates per labelled person.

    `counts` are long event tables, `series` cleaned series; both by output name.
    """
    parts = []
    for name, events in counts.items():
        total = events.groupBy(PERSON).agg(F.count(F.lit(1)).alias(name))
        parts.append(total)
    for name, rows in series.items():
        before = rows.where(F.col("dt") < base)
        parts.append(
            before.groupBy(PERSON).agg(
                F.max(F.struct("dt", "value"))["value"].alias(name),
                F.bool_or(F.col("abnorm_custom") == 1).cast("int").alias(f"{name}_abnorm"),
            )
        )
    return join_features(labels, [*parts, *covariates])
