"""Tests and tables that compare models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.evaluation import bootstrap, metrics
from labtrail.functions import recode
from labtrail.functions.special import log10_p_of_z, p_of_t
from labtrail.session import stage

# -------------------------------------------------------------------- DeLong


def delong(df: DataFrame, groups: Sequence[str], first: str, second: str, label: str) -> DataFrame:
    """AUCs of two correlated scores and the standard error of their difference.

    A case's component is the share of controls below it (ties half), a
    control's the share of cases above it. Rows are first reduced to distinct
    (label, score, score) cells with a count.
    """
    groups = list(groups)
    cells = (
        df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
        .groupBy(*groups, label, first, second)
        .agg(F.count(F.lit(1)).alias("_k"))
    )
    # both scores are ranked as one long table, and a cell's two components meet again by the cell
    scores = F.array(*[F.struct(F.lit(i).alias("_which"), F.col(x).alias("_score")) for i, x in ((1, first), (2, second))])
    long = cells.select("*", F.inline(scores))
    table = metrics.counted_scores(long, [*groups, "_which"], "_score", label, "_k")
    above = F.col("cases_total") - F.col("cases_below") - F.col("cases") / 2
    below = F.col("controls_below") + F.col("controls") / 2
    places = table.select(
        *groups,
        "_which",
        "_score",
        F.try_divide(below, F.col("controls_total")).alias("_case"),
        F.try_divide(above, F.col("cases_total")).alias("_control"),
    )
    component = F.when(F.col(label) == 1, F.col("_case")).otherwise(F.col("_control"))
    long = long.join(places, [*groups, "_which", "_score"]).withColumn("_v", component)
    cells = long.groupBy(*groups, label, first, second).agg(
        F.max("_k").alias("_k"), *[F.max(F.when(F.col("_which") == i, F.col("_v"))).alias(f"_v{i}") for i in (1, 2)]
    )
    k = F.col("_k")
    a, b = F.col("_v1"), F.col("_v2")
    per_class = cells.groupBy(*groups, label).agg(
        F.sum(k).alias("_n"),
        (F.sum(k * a) / F.sum(k)).alias("_m1"),
        (F.sum(k * b) / F.sum(k)).alias("_m2"),
        F.sum(k * (a - b) * (a - b)).alias("_dd"),
    )
    gap = F.col("_m1") - F.col("_m2")
    spread = F.try_divide(F.col("_dd") - F.col("_n") * gap * gap, F.col("_n") - 1)
    share = F.try_divide(spread, F.col("_n"))
    case = F.col(label) == 1
    out = per_class.groupBy(*groups).agg(
        F.max(F.when(case, F.col("_m1"))).alias("auc_1"),
        F.max(F.when(case, F.col("_m2"))).alias("auc_2"),
        # a class of one row has no variance
        F.when(F.count(share) == 2, F.sqrt(F.greatest(F.sum(share), F.lit(0.0)))).alias("se_diff"),
    )
    return out.withColumn("z", F.try_divide(F.abs(F.col("auc_1") - F.col("auc_2")), F.col("se_diff")))


def with_delong_p(tested: DataFrame) -> DataFrame:
    return tested.withColumn("log10_p", log10_p_of_z("z")).withColumn(
        "p", F.pow(F.lit(10.0), F.col("log10_p"))
    )


# ------------------------------------------------------------- paired tables


def join_pairs(
    predictions: DataFrame, pairs: Sequence[tuple[str, str]], goal: str = "y"
) -> DataFrame:
    """Rows where both models of a pair predicted, for every pair at once.

    `predictions` has model, person_id, split_set, the goal and prob. Models are
    a short list, so one pivot replaces a join per pair.
    """
    models = sorted({m for pair in pairs for m in pair})
    wide = (
        predictions.where(F.col("model").isin(models))
        .groupBy("person_id", "split_set", goal)
        .pivot("model", models)
        .agg(F.max("prob"))
    )
    lines = [
        F.struct(
            F.lit(a).alias("model_1"),
            F.lit(b).alias("model_2"),
            F.col(f"`{a}`").alias("prob_1"),
            F.col(f"`{b}`").alias("prob_2"),
        )
        for a, b in pairs
    ]
    long = wide.select(
        "person_id", "split_set", recode.any_risk(F.col(goal)).alias("y"), F.inline(F.array(*lines))
    )
    return long.where(F.col("prob_1").isNotNull() & F.col("prob_2").isNotNull())



def named_sets(column: str = "split_set") -> dict[str, Column]:
    """Evaluation sets; the last one is everything but the test set."""
    s = F.col(column)
    return {"Train": s == 0, "Tuning": s == 1, "Test": s == 2, "TrainTuning": s != 2}


def evaluation_grid(
    rows: DataFrame, membership: DataFrame, sets: Mapping[str, Column], least_cases: int, keys: Sequence[str]
) -> DataFrame:
    """Rows repeated per set and person filter; cells with few cases are left out."""
    names = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in sets.items()]))
    # both sides grow with the persons, and size estimates do not see that rows are repeated per model and set:
    # ask for a shuffled join, or all predictions are broadcast through the driver
    placed = rows.withColumn("set_name", F.explode(names)).join(
        membership.select("person_id", "filter").hint("merge"), "person_id"
    )
    cell = [*keys, "set_name", "filter"]
    if not least_cases:
        return placed
    enough = (
        placed.groupBy(*cell)
        .agg(F.sum("y").alias("_c"))
        .where(F.col("_c") >= least_cases)
        .drop("_c")
    )
    return placed.join(enough, cell, "left_semi")


def compare_models(
    predictions: DataFrame,
    pairs: Sequence[tuple[str, str]],
    membership: DataFrame,
    sets: Mapping[str, Column],
    replicates: int = 100,
    least_cases: int = 10,
    method: str = "poisson",
) -> DataFrame:
    """AUC, average precision and reclassification differences of all pairs."""
    keys = ["model_1", "model_2", "set_name", "filter"]
    # the grid is read by the draws, by their rows and by the test: build it once
    rows = stage(
        evaluation_grid(join_pairs(predictions, pairs), membership, sets, least_cases, keys[:2])
    )
    boot = bootstrap.bootstrap_diff(rows, keys, ["person_id"], "prob_1", "prob_2", "y", replicates, method)
    tested = delong(rows, keys, "prob_1", "prob_2", "y").select(*keys, "se_diff", "z")
    return boot.join(tested, keys)


def score_models(
    predictions: DataFrame,
    membership: DataFrame,
    sets: Mapping[str, Column],
    replicates: int = 100,
    goal: str = "y",
    method: str = "poisson",
) -> DataFrame:
    """AUC, average precision, Brier score and log loss with intervals per model."""
    keys = ["model", "set_name", "filter"]
    coded = predictions.withColumn("y", recode.any_risk(F.col(goal)))
    rows = stage(evaluation_grid(coded, membership, sets, 0, keys[:1]))
    y, p = F.col("y").cast("double"), F.col("prob")
    inside = F.greatest(F.least(p, F.lit(1 - metrics.EPSILON)), F.lit(metrics.EPSILON))
    loss = {"brier": (p - y) * (p - y), "logloss": F.when(y == 1, -F.log(inside)).otherwise(-F.log(1 - inside))}
    weighed = bootstrap.weighed(rows.select(*keys, "person_id", "prob", "y"), keys, ["person_id"], replicates, method)
    found = bootstrap.replicate_metrics(weighed, keys, {"": p}, "y", replicates, loss)
    found = found.withColumns({x: F.try_divide(F.col(f"{x}_case") + F.col(f"{x}_control"), F.col("n")) for x in loss})
    names = ["n", "n_case", "auc", "avg_prec", "brier", "logloss"]
    out = bootstrap.interval(found, keys, names)
    return out.drop("n_low", "n_high", "n_case_low", "n_case_high")


def metric_diff_row(
    predictions: DataFrame, full: str, reduced: str, metric: str, n_features: int, replicates: int = 500
) -> DataFrame:
    """One comparison row per set: estimate, interval and p of full against reduced."""
    rows = join_pairs(predictions, [(full, reduced)])
    boot = bootstrap.bootstrap_diff(rows, ["split_set"], ["person_id"], "prob_1", "prob_2", "y", replicates)
    name = {"auc": "auc", "avg_prec": "avg_prec"}[metric]
    return boot.select(
        "split_set",
        F.lit(metric).alias("metric"),
        F.lit(n_features).alias("n_features"),
        F.col(f"{name}_diff").alias("diff_est"),
        F.col(f"{name}_diff_low").alias("low_ci"),
        F.col(f"{name}_diff_high").alias("high_ci"),
        F.col(f"{name}_diff_p").alias("pval_diff"),
        F.col(f"{name}_1").alias("avg_full"),
        F.col(f"{name}_2").alias("avg_fs"),
    )


# ------------------------------------------------------------ two-group tests


def welch_t(n1: Column, mean1: Column, sd1: Column, n2: Column, mean2: Column, sd2: Column):
    """Unequal-variance t statistic and its degrees of freedom."""
    e1, e2 = F.try_divide(sd1 * sd1, n1), F.try_divide(sd2 * sd2, n2)
    t = F.try_divide(mean1 - mean2, F.sqrt(e1 + e2))
    df = F.try_divide(
        (e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, n1 - 1) + F.try_divide(e2 * e2, n2 - 1)
    )
    return t, df


def with_welch_p(tested: DataFrame) -> DataFrame:
    return tested.withColumn("p", p_of_t("t", "df"))


def prop_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Two-proportion z with pooled variance."""
    pooled = F.try_divide(k1 + k2, n1 + n2)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return F.try_divide(F.try_divide(k1, n1) - F.try_divide(k2, n2), error)


def with_prop_p(tested: DataFrame) -> DataFrame:
    return tested.withColumn("p", F.pow(F.lit(10.0), log10_p_of_z("z")))


# ------------------------------------------------------------ result tables


def round_min5(df: DataFrame, column: str, least: int = 5) -> DataFrame:
    """Round; a value seen less than `least` times moves to the nearer common extreme."""
    rounded = df.withColumn("_r", F.round(column))
    seen = rounded.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    often = seen.where(F.col("_n") >= least)
    ends = often.agg(F.struct(F.min("_r").alias("a"), F.max("_r").alias("b")).alias("e")).scalar()
    a, b = F.col("_e")["a"], F.col("_e")["b"]
    nearer = F.when(F.abs(a - F.col("_r")) < F.abs(b - F.col("_r")), a).otherwise(b)
    mapping = seen.withColumn("_e", ends).select("_r", F.when(F.col("_n") < least, nearer).otherwise(F.col("_r")).alias("rounded"))
    return rounded.join(mapping, "_r", "left").drop("_r")


def adjacent_pvalues(
    table: DataFrame, levels: Sequence[str] = recode.PREDICTOR_LEVELS, alpha: float = 0.05
) -> DataFrame:
    """p-value of each predictor set against the one before it, per lab.

    `table` has lab, model_1, predictors and p. A pair is found in either
    direction; a missing pair counts as 1, the first level as 0.
    """
    order = F.array(*[F.lit(x) for x in levels])
    a, b = F.array_position(order, F.col("model_1")), F.array_position(order, F.col("predictors"))
    steps = (
        table.where((a > 0) & (b > 0) & (F.abs(a - b) == 1))
        .groupBy("lab", F.greatest(a, b).alias("_level"))
        .agg(F.min(F.struct((a > b).alias("back"), "p"))["p"].alias("_p"))
    )
    spine = table.select("lab").distinct().select("lab", F.posexplode(order).alias("_i", "predictors"))
    found = spine.withColumn("_level", (F.col("_i") + 1).cast("long")).join(
        steps, ["lab", "_level"], "left"
    )
    p = F.when(F.col("_i") == 0, 0.0).otherwise(F.coalesce(F.col("_p"), F.lit(1.0)))
    return found.select(
        "lab", "predictors", p.alias("p"), F.when(p < alpha, "sig").otherwise("ns").alias("sign")
    )
