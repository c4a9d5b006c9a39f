"""Resampling with replacement as one grouped job.

Replicate 0 is the data itself. With the method "exact", replicate r draws exactly n rows: slot j
takes the row at place draw(j, r) modulo n of a fixed random order, a 62-bit number that is keyed by
the replicate. With "poisson" each row gets a weight from a Poisson distribution with mean 1, drawn from its
id and the replicate; the size of a replicate then varies around n.

Ranked metrics and reclassification come from `replicates`: rows carry their weights as vectors and are shuffled once,
whatever the number of replicates. Other metrics are sums per replicate, which combine before their shuffle.
`resample` gives the drawn rows themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.evaluation import metrics
from labtrail.evaluation.replicates import METHODS, exploded, replicate_metrics, weighed
from labtrail.functions.uniform import poisson_limits, row_number_of, with_draw
from labtrail.operators.ranking import random_position
from labtrail.session import spread


def _weighted(df: DataFrame, groups: list[str], ids: Sequence[str], replicates: int, columns: Sequence[str]) -> DataFrame:
    """Rows repeated by their weights; replicate 0 has every row once."""
    rows = df.select(*groups, *columns, row_number_of(*ids, salt="weight").alias("_row"))
    # rows grow by the number of replicates here, which size estimates do not see
    rows = spread(rows).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    rows = with_draw(rows, "_row", "replicate")
    limits = F.array(*[F.lit(x) for x in poisson_limits()])
    # a lambda's variable is computed once; a column named in each comparison would be pasted into all
    weight = F.transform(F.array("_draw"), lambda d: F.size(F.filter(limits, lambda x: x <= d)))[0]
    weight = F.when(F.col("replicate") == 0, 1).otherwise(weight)
    rows = rows.withColumn("_times", weight).where(F.col("_times") > 0)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return rows.select(*groups, "replicate", *columns)


def resample(
    df: DataFrame,
    groups: Sequence[str],
    ids: Sequence[str],
    replicates: int,
    columns: Sequence[str],
    method: str = "exact",
) -> DataFrame:
    """`columns` of the original rows and of all drawn rows, with `replicate`."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    groups = list(groups)
    if method == "poisson":
        return _weighted(df, groups, ids, replicates, columns)
    placed = random_position(df, groups, ids, "row", "_pos", "_size")
    # rows grow by the number of replicates here, which size estimates do not see:
    # spread them first, and ask for a shuffled join instead of a broadcast
    slots = spread(placed.select(*groups, "_pos", "_size"), *groups, "_pos")
    slots = slots.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    slots = with_draw(slots, "_pos", "replicate")
    draw = F.col("_draw") % F.col("_size")
    drawn = slots.select(*groups, "replicate", draw.alias("_pos")).join(
        placed.select(*groups, "_pos", *columns).hint("merge"), [*groups, "_pos"]
    )
    whole = df.select(*groups, F.lit(0).alias("replicate"), *columns)
    return whole.unionByName(drawn.select(*groups, "replicate", *columns))


def estimate(metric: str) -> Column:
    return F.max(F.when(F.col("replicate") == 0, F.col(metric)))


def sorted_replicates(metric: str) -> Column:
    """Values of the replicates that have one; as many as there are replicates."""
    return F.sort_array(F.collect_list(F.when(F.col("replicate") > 0, F.col(metric))))


def at_share(values: Column, share: float) -> Column:
    return F.get(values, F.floor(F.size(values) * F.lit(share)).cast("int"))


def interval(per_replicate: DataFrame, groups: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Estimate and 95 percent interval of each named metric."""
    grouped = per_replicate.groupBy(*groups).agg(
        *[estimate(m).alias(m) for m in names],
        *[sorted_replicates(m).alias(f"_{m}") for m in names],
    )
    bounds = {}
    for m in names:
        bounds[f"{m}_low"] = at_share(F.col(f"_{m}"), 0.025)
        bounds[f"{m}_high"] = at_share(F.col(f"_{m}"), 0.975)
    return grouped.withColumns(bounds).drop(*[f"_{m}" for m in names])


def bootstrap_ci(
    df: DataFrame,
    groups: Sequence[str],
    ids: Sequence[str],
    name: str,
    prediction: str,
    label: str,
    replicates: int = 500,
    method: str = "exact",
) -> DataFrame:
    rows = weighed(df.select(*groups, *ids, prediction, label), groups, ids, replicates, method)
    if name in metrics.RANKED:
        found = replicate_metrics(rows, groups, {"": F.col(prediction)}, label, replicates)
        found = found.withColumn("value", F.col(metrics.RANKED[name]))
    else:
        found = metrics.metric(exploded(rows, replicates), [*groups, "replicate"], name, prediction, label, "weight")
    return interval(found, groups, ["value"])


def paired_metrics(
    rows: DataFrame, keys: Sequence[str], first: str, second: str, label: str
) -> DataFrame:
    """AUC and average precision of two scores and the reclassification between them."""
    # score 3 is the direction of the move, whose class means give the reclassification
    scores = {1: F.col(first), 2: F.col(second), 3: F.signum(F.col(second) - F.col(first))}
    long = rows.select(
        *keys,
        label,
        F.inline(
            F.array(*[F.struct(F.lit(i).alias("which"), s.alias("score")) for i, s in scores.items()])
        ),
    )
    ranked = metrics.ranked_metrics(long, [*keys, "which"], "score", label)

    def of(which: int, column: str) -> Column:
        return F.max(F.when(F.col("which") == which, F.col(column)))

    return (
        ranked.groupBy(*keys)
        .agg(
            of(1, "n").alias("n"),
            of(1, "n_case").alias("n_case"),
            *[of(w, c).alias(f"{c}_{w}") for c in ("auc", "avg_prec") for w in (1, 2)],
            of(3, "mean_gap").alias("nri"),
        )
        .withColumns(
            {
                "auc_diff": F.col("auc_2") - F.col("auc_1"),
                "avg_prec_diff": F.col("avg_prec_2") - F.col("avg_prec_1"),
            }
        )
    )


def paired_replicates(
    rows: DataFrame, groups: Sequence[str], first: str, second: str, label: str, replicates: int
) -> DataFrame:
    """`paired_metrics` of every replicate, from rows of `weighed`."""
    both = F.col(first).isNotNull() & F.col(second).isNotNull()
    values = {
        "move": F.when(both, F.signum(F.col(second) - F.col(first))).otherwise(0),
        "both": both.cast("double"),
    }
    found = replicate_metrics(rows, groups, {"1": F.col(first), "2": F.col(second)}, label, replicates, values)

    def of(which: int, column: str) -> Column:
        return F.max(F.when(F.col("which") == str(which), F.col(column)))

    up, down = (F.try_divide(of(1, f"move_{c}"), of(1, f"both_{c}")) for c in ("case", "control"))
    return (
        found.groupBy(*groups, "replicate")
        .agg(
            of(1, "n").alias("n"),
            of(1, "n_case").alias("n_case"),
            *[of(w, c).alias(f"{c}_{w}") for c in ("auc", "avg_prec") for w in (1, 2)],
            (up - down).alias("nri"),
        )
        .withColumns(
            {
                "auc_diff": F.col("auc_2") - F.col("auc_1"),
                "avg_prec_diff": F.col("avg_prec_2") - F.col("avg_prec_1"),
            }
        )
    )


def difference_p(values: Column, total: Column) -> Column:
    """Share of replicates at least as far from the estimate as from zero."""
    far = F.size(F.filter(values, lambda d: F.abs(total - d) >= F.abs(d)))
    return F.try_divide(far, F.size(values))


def paired_interval(per_replicate: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Estimates, intervals and p-values of the differences between two models."""
    plain = ["n", "n_case", "auc_1", "auc_2", "avg_prec_1", "avg_prec_2"]
    tested = ["auc_diff", "avg_prec_diff", "nri"]
    grouped = per_replicate.groupBy(*groups).agg(
        *[estimate(m).alias(m) for m in [*plain, *tested]],
        *[sorted_replicates(m).alias(f"_{m}") for m in tested],
    )
    extra = {}
    for m in tested:
        extra[f"{m}_low"] = at_share(F.col(f"_{m}"), 0.025)
        extra[f"{m}_high"] = at_share(F.col(f"_{m}"), 0.975)
        extra[f"{m}_p"] = difference_p(F.col(f"_{m}"), F.col(m))
    return grouped.withColumns(extra).drop("nri_p", *[f"_{m}" for m in tested])


def bootstrap_diff(
    df: DataFrame,
    groups: Sequence[str],
    ids: Sequence[str],
    first: str,
    second: str,
    label: str,
    replicates: int = 500,
    method: str = "exact",
) -> DataFrame:
    rows = weighed(df.select(*groups, *ids, first, second, label), groups, ids, replicates, method)
    return paired_interval(paired_replicates(rows, groups, first, second, label, replicates), groups)


def bootstrap_nri(
    df: DataFrame,
    groups: Sequence[str],
    ids: Sequence[str],
    old: str,
    new: str,
    label: str,
    replicates: int = 500,
    method: str = "exact",
) -> DataFrame:
    rows = weighed(df.select(*groups, *ids, old, new, label), groups, ids, replicates, method)
    # sums need no order: all rows of a group share one score
    move = {"move": F.coalesce(F.signum(F.col(new) - F.col(old)), F.lit(0.0))}
    found = replicate_metrics(rows.where(F.col(label).isNotNull()), groups, {"": F.lit(0.0)}, label, replicates, move)
    up, down = F.try_divide("move_case", "n_case"), F.try_divide("move_control", F.col("n") - F.col("n_case"))
    return interval(found.withColumn("nri", up - down), groups, ["nri"])
