"""Exact ranks, quantiles and random orders without a single-task sort.

A plain `rank() over (order by score)` sends a whole group to one task. Here
every group is cut into cells that keep the order, at quantiles that a mergeable sketch of its
distinct scores estimates, so cells hold about equally many scores however narrow the band of the
scores is. Cells are counted with a map-side combine, a window runs over the short table of cells, and a second
window runs inside each cell. The sketch only places the cuts; the results are the exact ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labtrail.functions.uniform import uniform

#: Cells of a group, and the share of its distinct scores by which a cut may be off.
RANK_CELLS = 64
SKETCH = 1000
ORDER_CELLS = 4096


def with_cell(scores: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Add `_cell`, which never decreases with the score in a group; `keys` may be empty."""
    shares = [k / RANK_CELLS for k in range(1, RANK_CELLS)]
    sketch = F.percentile_approx(F.col(score).cast("double"), shares, SKETCH).alias("_cuts")
    if keys:
        # one row for each group
        placed = scores.join(scores.groupBy(*keys).agg(sketch), list(keys))
    else:
        placed = scores.withColumn("_cuts", scores.agg(sketch).scalar())
    value = F.col(score).cast("double")
    return placed.withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < value))).drop("_cuts")


def _before(column: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    frame = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum(column).over(frame), F.lit(0))


def _known(columns: Sequence[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull()
    return test


def score_table(
    df: DataFrame, groups: Sequence[str], score: str, sums: dict[str, Column]
) -> DataFrame:
    """One row per group and distinct score with running and total sums.

    For each entry of `sums` the output has `<name>` (at this score),
    `<name>_below` (strictly smaller scores) and `<name>_total` (whole group).
    Rows with a null score or group are left out.
    """
    groups = list(groups)
    # stating what is not null keeps both uses of `scores` alike, so that its
    # exchange is computed once and reused
    work = df.where(_known([*groups, score]))
    scores = work.groupBy(*groups, score).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    scores = with_cell(scores, groups, score)
    keys = groups
    if not groups:
        keys = ["_all"]
        scores = scores.withColumn("_all", F.lit(1))
    whole = Window.partitionBy(*keys)
    cells = (
        scores.groupBy(*keys, "_cell")
        .agg(*[F.sum(n).alias(n) for n in sums])
        .select(
            *keys,
            "_cell",
            *[_before(n, keys, ["_cell"]).alias(f"_{n}_before") for n in sums],
            *[F.sum(n).over(whole).alias(f"{n}_total") for n in sums],
        )
    )
    return scores.join(cells, [*keys, "_cell"]).select(
        *groups,
        score,
        *sums,
        *[
            (F.col(f"_{n}_before") + _before(n, [*keys, "_cell"], [score])).alias(f"{n}_below")
            for n in sums
        ],
        *[f"{n}_total" for n in sums],
    )


def quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    points: Mapping[str, float],
    method: str = "linear",
    nearest: Mapping[str, float] | None = None,
    mean: str | None = None,
) -> DataFrame:
    """Exact quantiles per group; `method` is "linear" or "nearest".

    `nearest` adds nearest-rank points to linear ones, and `mean` names a column
    for the mean, so that one pass over the data serves all of them.
    """
    table = score_table(df, groups, value, {"_n": F.lit(1)})

    def at(index: Column) -> Column:
        here = (F.col("_n_below") <= index) & (index < F.col("_n_below") + F.col("_n"))
        return F.max(F.when(here, F.col(value)))

    def place(share: float) -> Column:
        return (F.col("_n_total") - 1) * F.lit(float(share))

    by_rank = dict(nearest or {}, **(points if method == "nearest" else {}))
    columns = {}
    for name, share in points.items():
        if name not in by_rank:
            low, high = at(F.floor(place(share))), at(F.ceil(place(share)))
            columns[name] = low + (high - low) * F.max(place(share) - F.floor(place(share)))
    for name, share in by_rank.items():
        columns[name] = at(F.floor(place(share) + 0.5))
    if mean:
        columns[mean] = F.sum(F.col(value) * F.col("_n")) / F.sum("_n")
    return table.groupBy(*groups).agg(*[c.alias(n) for n, c in columns.items()])


def random_position(
    df: DataFrame,
    groups: Sequence[str],
    ids: Sequence[str],
    salt: str,
    position: str = "pos",
    size: str = "n_group",
) -> DataFrame:
    """Add each row's 0-based place in a reproducible shuffle of its group.

    Rows are ordered by (uniform(ids, salt), ids). The shuffle is cut into
    `ORDER_CELLS` equal slices, so a group of any size is sorted by many tasks.
    """
    groups = list(groups)
    cell = F.coalesce(F.floor(F.col("_u") * ORDER_CELLS), F.lit(0).cast("long"))
    work = df.where(_known(groups)).withColumns({"_u": uniform(*ids, salt=salt)})
    work = work.withColumn("_cell", cell)
    keys = groups
    if not groups:
        keys = ["_all"]
        work = work.withColumn("_all", F.lit(1))
    whole = Window.partitionBy(*keys)
    cells = (
        work.groupBy(*keys, "_cell")
        .agg(F.count(F.lit(1)).alias("_k"))
        .select(
            *keys,
            "_cell",
            _before("_k", keys, ["_cell"]).alias("_start"),
            F.sum("_k").over(whole).alias(size),
        )
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy("_u", *ids)
    return (
        work.join(cells, [*keys, "_cell"])
        .withColumn(position, F.col("_start") + F.row_number().over(inside) - 1)
        .select(*df.columns, position, size)
    )
