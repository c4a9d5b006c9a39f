"""Metrics per group: ranked ones from distinct scores, the others as averages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.operators.ranking import quantiles, score_table

# ------------------------------------------------------------ ranked metrics


def counted_scores(
    df: DataFrame, groups: Sequence[str], score: str, label: str, weight: str | None = None
) -> DataFrame:
    """Cases and controls at and below every distinct score of a group."""
    w = F.col(weight) if weight else F.lit(1)
    case = F.col(label) == 1
    return score_table(
        df, groups, score, {"cases": F.when(case, w).otherwise(0), "controls": F.when(case, 0).otherwise(w)}
    )


def ranked_metrics(
    df: DataFrame, groups: Sequence[str], score: str, label: str, weight: str | None = None
) -> DataFrame:
    """Number of rows and cases, ROC AUC and average precision per group.

    Ties count half for the AUC and share one step for the precision. A group
    with one class only has no AUC. `mean_gap` is the mean score of the cases
    minus that of the controls.
    """
    table = counted_scores(df, groups, score, label, weight)
    cases, controls = F.col("cases").cast("double"), F.col("controls").cast("double")
    m, n = F.col("cases_total").cast("double"), F.col("controls_total").cast("double")
    hits = m - F.col("cases_below")
    false = n - F.col("controls_below")
    return table.groupBy(*groups).agg(
        (F.sum("cases") + F.sum("controls")).alias("n"),
        F.sum("cases").alias("n_case"),
        F.try_divide(F.sum(cases * (F.col("controls_below") + controls / 2)), F.max(m * n)).alias("auc"),
        F.try_divide(F.sum(cases * F.try_divide(hits, hits + false)), F.max(m)).alias("avg_prec"),
        (
            F.try_divide(F.sum(cases * F.col(score)), F.max(m))
            - F.try_divide(F.sum(controls * F.col(score)), F.max(n))
        ).alias("mean_gap"),
    )


def roc_curve(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """False and true positive rate per threshold (score >= threshold is positive).

    The starting point (0, 0) has no threshold.
    """
    table = counted_scores(df, groups, score, label)
    m, n = F.col("cases_total"), F.col("controls_total")
    points = table.select(
        *groups,
        F.col(score).alias("threshold"),
        F.try_divide(n - F.col("controls_below"), n).alias("fpr"),
        F.try_divide(m - F.col("cases_below"), m).alias("tpr"),
    )
    none = F.lit(None).cast("double").alias("threshold")
    start = table.groupBy(*groups).agg(F.count(F.lit(1))).select(
        *groups, none, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def pr_curve(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    table = counted_scores(df, groups, score, label)
    hits = F.col("cases_total") - F.col("cases_below")
    false = F.col("controls_total") - F.col("controls_below")
    return table.select(
        *groups,
        F.col(score).alias("threshold"),
        F.try_divide(hits, hits + false).alias("precision"),
        F.try_divide(hits, F.col("cases_total")).alias("recall"),
    )


def pr_balance_cutoff(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Smallest threshold at which precision and recall are closest."""
    gap = F.abs(F.col("precision") - F.col("recall"))
    best = F.min(F.struct(gap.alias("gap"), "threshold"))
    return pr_curve(df, groups, score, label).groupBy(*groups).agg(best["threshold"].alias("cutoff"))


# ---------------------------------------------------------- averaged metrics

EPSILON = 2.220446049250313e-16


def _mean(value: Column, w: Column) -> Column:
    return F.try_divide(F.sum(value * w), F.sum(w))


def brier(y: Column, p: Column, w: Column) -> Column:
    return _mean((p - y) * (p - y), w)


def log_loss(y: Column, p: Column, w: Column) -> Column:
    inside = F.greatest(F.least(p, F.lit(1 - EPSILON)), F.lit(EPSILON))
    return _mean(F.when(y == 1, -F.log(inside)).otherwise(-F.log(1 - inside)), w)


def mae(y: Column, p: Column, w: Column) -> Column:
    return _mean(F.abs(y - p), w)


def mse(y: Column, p: Column, w: Column) -> Column:
    return _mean((y - p) * (y - p), w)


def rmse(y: Column, p: Column, w: Column) -> Column:
    return F.sqrt(mse(y, p, w))


def pinball(share: float) -> Callable[[Column, Column, Column], Column]:
    def loss(y: Column, p: Column, w: Column) -> Column:
        return _mean(F.when(y >= p, (y - p) * share).otherwise((p - y) * (1 - share)), w)

    return loss


def f1(y: Column, p: Column, w: Column) -> Column:
    """`p` is the predicted class."""
    hit = F.sum(F.when((y == 1) & (p == 1), w).otherwise(0))
    return F.try_divide(2.0 * hit, F.sum(F.when(y == 1, w).otherwise(0)) + F.sum(F.when(p == 1, w).otherwise(0)))


def tweedie_d2(y: Column, p: Column, w: Column) -> Column:
    """Share of deviance explained at power 0."""
    mean = _mean(y, w)
    total = F.sum(y * y * w) - F.sum(w) * mean * mean
    return 1 - F.try_divide(F.sum((y - p) * (y - p) * w), total)


METRICS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "brier": brier,
    "logloss": log_loss,
    "mae": mae,
    "mse": mse,
    "rmse": rmse,
    "f1": f1,
    "tweedie": tweedie_d2,
    **{f"q{q:02d}": pinball(q / 100) for q in (5, 10, 25, 50, 75, 90, 95)},
}
RANKED = {"auc": "auc", "aucpr": "avg_prec"}


def metric(
    df: DataFrame, groups: Sequence[str], name: str, prediction: str, label: str, weight: str | None = None
) -> DataFrame:
    """One metric of the registry per group, as column `value`."""
    if name in RANKED:
        out = ranked_metrics(df, groups, prediction, label, weight)
        return out.select(*groups, F.col(RANKED[name]).alias("value"))
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}")
    w = F.col(weight) if weight else F.lit(1)
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return df.groupBy(*groups).agg(METRICS[name](y, p, w).alias("value"))


def confusion(df: DataFrame, groups: Sequence[str], predicted: str, label: str) -> DataFrame:
    return df.groupBy(*groups).agg(
        *[
            F.count_if((F.col(label) == y) & (F.col(predicted) == p)).alias(name)
            for name, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
        ]
    )


def nri_column(y: Column, old: Column, new: Column, w: Column) -> Column:
    """Continuous net reclassification: cases moved up plus controls moved down."""
    move = F.signum(new - old)
    cases = F.when(y == 1, w)
    controls = F.when(y == 0, w)
    up = F.try_divide(F.sum(move * cases), F.sum(cases))
    down = F.try_divide(F.sum(move * controls), F.sum(controls))
    return up - down


def nri(df: DataFrame, groups: Sequence[str], old: str, new: str, label: str) -> DataFrame:
    column = nri_column(F.col(label), F.col(old), F.col(new), F.lit(1))
    return df.groupBy(*groups).agg(column.alias("nri"))


# ----------------------------------------------------------------- calibration

EQUAL_EDGES = [i * 0.1 for i in range(11)]


def _bin(p: Column, edges: Sequence[Column]) -> Column:
    """1-based bin (lo, hi]; null outside the edges."""

    def place(x: Column) -> Column:
        return sum(((e < x).cast("int") for e in edges), F.lit(0))

    # lambda variables are computed once; a score that is an expression would be pasted into every comparison
    found = F.transform(F.transform(F.array(p), place), lambda k: F.when((k >= 1) & (k < len(edges)), k))
    return F.get(found, F.lit(0))


def calibration_bins(
    df: DataFrame,
    score: str,
    label: str,
    kind: str = "equal",
    least: int = 5,
) -> DataFrame:
    """Predicted mean and observed rate per bin with at least `least` of each class."""
    if kind == "equal":
        work, edges = df, [F.lit(e) for e in EQUAL_EDGES]
    else:
        points = {f"e{i}": min(e, 1.0) for i, e in enumerate(EQUAL_EDGES)}
        row = quantiles(df, [], score, points)
        work = df.withColumn("_e", row.select(F.struct(*points).alias("e")).scalar())
        edges = [F.col("_e")[name] for name in points]
    binned = work.withColumn("bin", _bin(F.col(score), edges)).where(F.col("bin").isNotNull())
    cases, controls = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return (
        binned.groupBy("bin")
        .agg(
            F.avg(score).alias("predicted"),
            F.avg(label).alias("observed"),
            F.count(F.lit(1)).alias("n"),
            cases.alias("n_case"),
            controls.alias("n_control"),
        )
        .where((F.col("n_case") >= least) & (F.col("n_control") >= least))
    )


def with_beta_interval(bins: DataFrame) -> DataFrame:
    """95 percent interval of the observed rate from Beta(0.1 + cases, 0.1 + controls)."""
    from labtrail.functions.special import beta_point

    a, b = F.col("n_case") + 0.1, F.col("n_control") + 0.1
    return bins.withColumns(
        {"low": beta_point(F.lit(0.025), a, b), "high": beta_point(F.lit(0.975), a, b)}
    )


def ece(df: DataFrame, groups: Sequence[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins (lo, hi]."""
    edges = [F.lit(i * (1 / bins)) for i in range(bins + 1)]
    total = df.groupBy(*groups, _bin(F.col(score), edges).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(score).alias("_p"), F.sum(label).alias("_y")
    )
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_y") - F.col("_p"))).otherwise(0)
    return total.groupBy(*groups).agg((F.sum(gap) / F.sum("_n")).alias("ece"))
