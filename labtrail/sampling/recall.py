"""Recall sampling: probability bins, plans and stratified draws.

Plans are folds over one array of all bins, at most a few hundred, inside the query's own plan: no job runs while a
query is built. Repeated draws are bottom-k samples: every task keeps the first persons of each draw's random order per bin and
site, so that a shuffle carries a plan's worth of persons per task and draw, not persons x draws. `sample_plan`, `bin_merge` and
`plan_collapse` are the same folds for callers that hold the numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labtrail.evaluation import bootstrap, metrics
from labtrail.functions.uniform import uniform
from labtrail.operators.cohort import with_age
from labtrail.operators.extract import min_age
from labtrail.operators.ranking import quantiles, random_position
from labtrail.session import stage

PERSON = "person_id"
# fixed values: recall sites and the biobank behind each
SITES = {"TAMPERE BIOBANK": "Tampere", "AURIA BIOBANK": "Turku"}
# slices of a cell's random order that are ranked apart
SLICES = 64


def site_label(predictions: DataFrame, persons: DataFrame) -> DataFrame:
    """Predictions outside the training set of persons at a recall site."""
    place = F.col("cohort")
    site = None
    for cohort, name in SITES.items():
        site = (F if site is None else site).when(place == cohort, name)
    labelled = persons.select(PERSON, site.alias("site")).where(F.col("site").isNotNull())
    return predictions.where(F.col("split_set") != 0).join(labelled, PERSON)


#: Youngest age of a candidate.
MIN_AGE = 30


def candidates(predictions: DataFrame, persons: DataFrame, date: Column, years: float = MIN_AGE) -> DataFrame:
    """Labelled predictions of persons of at least `years` at `date`, with `event_age`; an unknown age is too young."""
    return min_age(with_age(site_label(predictions, persons), persons, date), years)


@dataclass(frozen=True)
class Bins:
    """Probability bins [lower, upper); `cuts` are the inner and the last bound."""

    lowest: float
    cuts: tuple[float, ...]

    def rows(self) -> list[tuple[int, float, float, float]]:
        """(group, lower, upper, midpoint rounded to 3)."""
        bounds = [self.lowest, *self.cuts]
        out = []
        for i, (low, high) in enumerate(zip(bounds, bounds[1:]), start=1):
            mid = Decimal(repr(low + (high - low) / 2)).quantize(Decimal("0.001"), ROUND_HALF_UP)
            out.append((i, low, high, float(mid)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "group int, lower double, cut double, mid double")


def prob_bins(df: DataFrame, bins: Bins, score: str = "prob") -> DataFrame:
    """Attach group, bounds and midpoint; scores above the last cut are left out."""
    kept = df.where(F.col(score) <= bins.cuts[-1])
    group = sum(((F.col(score) >= c).cast("int") for c in bins.cuts[:-1]), F.lit(1))
    table = F.broadcast(bins.table(df.sparkSession))  # at most a few hundred bins
    return kept.withColumn("group", group).join(table, "group", "left")


def bin_capacity(binned: DataFrame, per_site: bool = True) -> DataFrame:
    """Rows per bin: the smallest site's count, or all rows."""
    counts = binned.groupBy("group", "site").agg(F.count(F.lit(1)).alias("n"))
    if not per_site:
        return counts.groupBy("group").agg(F.sum("n").alias("capacity"))
    smallest = F.when(F.count(F.lit(1)) == len(SITES), F.min("n")).otherwise(0)
    return counts.groupBy("group").agg(smallest.alias("capacity"))


def merged_bins(df: DataFrame, bins: Bins, score: str = "prob", least: int = 10) -> DataFrame:
    """Rows (`group`, `lower`, `cut`, `mid`) of the bins that are left when cuts are dropped until
    every bin holds `least` persons per site.

    Counts of merged bins add up, so persons are counted once in the finest bins, and one fold over
    the array of these bins decides which cuts stay. The last cut is the one at which the count last changed.
    """
    group = sum(((F.col(score) >= c).cast("int") for c in bins.cuts), F.lit(0))
    sites = [F.count_if(F.col("site") == s).alias(f"s{k}") for k, s in enumerate(SITES.values())]
    counts = df.groupBy(group.alias("g")).agg(*sites)
    fine = df.sparkSession.createDataFrame(list(enumerate(bins.cuts)), "g int, cut double")
    some = [F.coalesce(f"s{k}", F.lit(0)).cast("long").alias(f"s{k}") for k in range(len(sites))]
    # a row for each finest bin
    one = fine.join(counts, "g", "left").agg(F.sort_array(F.collect_list(F.struct("g", "cut", *some))).alias("bins"))

    def step(state: Column, x: Column) -> Column:
        summed = [state["sums"][k] + x[f"s{k}"] for k in range(len(sites))]
        size = F.least(*summed)
        full, changed = size >= least, (size < least) & (size != state["last_size"])
        return F.struct(
            F.when(full, F.array(*[F.lit(0).cast("long")] * len(sites))).otherwise(F.array(*summed)).alias("sums"),
            F.when(full, F.concat(state["cuts"], F.array(x["cut"]))).otherwise(state["cuts"]).alias("cuts"),
            F.when(changed, size).otherwise(state["last_size"]).alias("last_size"),
            F.when(changed, x["cut"]).otherwise(state["last_cut"]).alias("last_cut"),
        )

    start = F.struct(
        F.array(*[F.lit(0).cast("long")] * len(sites)).alias("sums"),
        F.array().cast("array<double>").alias("cuts"),
        F.lit(0).cast("long").alias("last_size"),
        F.lit(1.0).alias("last_cut"),
    )
    done = one.select(F.aggregate("bins", start, step).alias("s"))
    # the last cut replaces the last one kept; without any it is the only one
    kept = F.slice("s.cuts", 1, F.greatest(F.size("s.cuts") - 1, F.lit(0)))
    done = done.select(F.concat(kept, F.array("s.last_cut")).alias("cuts"))
    lower = F.when(F.col("i") == 0, F.lit(bins.lowest)).otherwise(F.get("cuts", F.col("i") - 1))
    rows = done.select("cuts", F.posexplode("cuts").alias("i", "cut")).withColumn("lower", lower)
    mid = F.round(F.col("lower") + (F.col("cut") - F.col("lower")) / 2, 3)
    return rows.select((F.col("i") + 1).alias("group"), "lower", "cut", mid.alias("mid"))


def bin_merge(df: DataFrame, bins: Bins, score: str = "prob", least: int = 10) -> Bins:
    """`merged_bins`, fetched."""
    rows = merged_bins(df, bins, score, least).collect()
    return Bins(bins.lowest, tuple(r["cut"] for r in sorted(rows, key=lambda r: r["group"])))


def _even(x: float) -> int:
    """Nearest even number; halves go to the even quotient."""
    return int(round(x / 2) * 2)


def sample_plan(total: int, capacity: Sequence[int]) -> list[float]:
    """Spread `total` over the bins in three rounds, each bin within its capacity."""
    room = [_even(c) for c in capacity]
    sizes: list[float] = [total / len(room)] * len(room)
    full: set[int] = set()
    for _ in range(2):
        full |= {i for i, size in enumerate(sizes) if room[i] < size}
        sizes = [min(size, room[i]) for i, size in enumerate(sizes)]
        free = [i for i in range(len(room)) if i not in full]
        if not free:
            break
        share = _even((total - sum(sizes[i] for i in full)) / len(free))
        for i in free:
            sizes[i] = share
    return [min(size, room[i]) for i, size in enumerate(sizes)]


def planned(capacity: DataFrame, bins: Bins, total: int) -> DataFrame:
    """`sample_plan` of all bins as rows (`group`, `capacity`, `n`); a bin without rows in `capacity` has none.

    The rounds are transformations of one array that holds a struct for each bin.
    """

    def even(x: Column) -> Column:
        return F.bround(x / 2, 0) * 2

    def state(x: Column, size: Column, full: Column) -> Column:
        return F.struct(x["group"].alias("group"), x["capacity"].alias("capacity"), x["room"].alias("room"), size.alias("size"), full.alias("full"))

    table = bins.table(capacity.sparkSession).select("group").join(capacity, "group", "left")
    room = F.coalesce("capacity", F.lit(0)).cast("double")
    line = F.struct("group", F.coalesce("capacity", F.lit(0)).alias("capacity"), even(room).alias("room"))
    one = table.agg(F.sort_array(F.collect_list(line)).alias("_a"))
    first = F.lit(float(total)) / len(bins.cuts)
    one = one.select(F.transform("_a", lambda x: state(x, first, F.lit(False))).alias("_a"))
    for _ in range(2):
        one = one.select(
            F.transform("_a", lambda x: state(x, F.least(x["size"], x["room"]), x["full"] | (x["room"] < x["size"]))).alias("_a")
        )
        used = F.aggregate("_a", F.lit(0.0), lambda sums, x: sums + F.when(x["full"], x["size"]).otherwise(0.0))
        free = F.size(F.filter("_a", lambda x: ~x["full"]))
        one = one.withColumn("_share", even(F.try_divide(F.lit(float(total)) - used, free)))
        one = one.select(F.transform("_a", lambda x: state(x, F.when(x["full"], x["size"]).otherwise(F.col("_share")), x["full"])).alias("_a"))
    return one.select(F.inline("_a")).select("group", "capacity", F.least("size", "room").alias("n"))


def by_site(plan: DataFrame) -> DataFrame:
    """The plan split evenly over the sites: `group`, `site`, `n`, `max_n`."""
    sites = F.explode(F.array(*[F.lit(s) for s in SITES.values()])).alias("site")
    return plan.select("group", sites, (F.col("n") / len(SITES)).alias("n"), F.col("capacity").alias("max_n"))


def collapsed(plan: DataFrame, bins: Bins, coarse: Sequence[float]) -> DataFrame:
    """Sizes of a plan's bins added up per coarse bin (previous cut, cut]."""
    inside = [(k, i) for k, cut in enumerate(bins.cuts, 1) for i, (low, high) in enumerate(zip([bins.lowest, *coarse], coarse), 1) if low < cut <= high]
    table = plan.sparkSession.createDataFrame(inside, "group int, coarse int")
    return plan.join(F.broadcast(table), "group").groupBy(F.col("coarse").alias("group")).agg(F.sum("n").alias("n"))  # a row per bin


def plan_by_site(
    spark: SparkSession, sizes: Mapping[int, float], capacity: Sequence[int] | None = None
) -> DataFrame:
    """The plan split evenly over the sites."""
    rows = [(g, size, capacity[g - 1] if capacity is not None else None) for g, size in sizes.items()]
    return by_site(spark.createDataFrame(rows, "group int, n double, capacity int"))


def plan_collapse(
    coarse: Sequence[float], fine: Sequence[float], sizes: Mapping[int, float], lowest: float
) -> dict[int, float]:
    """Sizes of fine bins added up per coarse bin (previous cut, cut]."""
    out: dict[int, float] = {}
    for i, (low, high) in enumerate(zip([lowest, *coarse], coarse), start=1):
        inside = [sizes[k] for k, cut in enumerate(fine, start=1) if low < cut <= high]
        if inside:
            out[i] = float(sum(inside))
    return out


def stratified_draw(
    binned: DataFrame, sizes: Mapping[int, float] | DataFrame, salt: str = "draw", most: int | None = None
) -> DataFrame:
    """Random persons per (bin, site), as many as planned or as there are.

    `sizes` has the persons of each bin. With a table, `most` is a bound for each bin, such as the plan's total.
    """
    if isinstance(sizes, DataFrame):
        if most is None:
            raise ValueError("a table of sizes needs a bound")
        plan = by_site(sizes)
    else:
        plan = plan_by_site(binned.sparkSession, sizes)
        most = int(max(sizes.values(), default=0))
    most = int(most / len(SITES))
    cell = ["group", "site"]
    planned = binned.join(F.broadcast(plan), cell)  # two rows per bin
    # first per slice of the random order, so that a large cell is ranked by many tasks
    work = planned.withColumn("_u", uniform(PERSON, salt=salt)).withColumn("_slice", F.floor(F.col("_u") * SLICES))
    inner = Window.partitionBy(*cell, "_slice").orderBy("_u", PERSON)
    work = work.withColumn("_k", F.row_number().over(inner)).where(F.col("_k") <= most)
    order = Window.partitionBy(*cell).orderBy("_u", PERSON)
    ranked = work.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most)
    return ranked.where(F.col("_k") <= F.floor("n")).drop("_k", "_u", "_slice")


def draw_excluding(
    others: Sequence[tuple[DataFrame, Mapping[int, float] | DataFrame, float]], salt: str = "draw", most: int | None = None
) -> DataFrame:
    """Persons drawn for other labs in turn; somebody already drawn is not drawn again.

    Each entry has the binned predictions, the plan and the lowest probability.
    """
    drawn: DataFrame | None = None
    for i, (binned, sizes, lowest) in enumerate(others):
        pool = binned.where(F.col("prob") > lowest)
        if drawn is not None:
            pool = pool.join(drawn, PERSON, "left_anti")
        new = stratified_draw(pool, sizes, f"{salt}{i}", most).select(PERSON)
        drawn = new if drawn is None else drawn.unionByName(new)
    return drawn


def participation(
    df: DataFrame, share: float, groups: Sequence[str] = (), salt: str = "take"
) -> DataFrame:
    """A random `share` of the rows of each group, rounded down."""
    placed = random_position(df, list(groups), [PERSON, *groups], salt, "_k", "_size")
    taken = F.col("_k") < F.floor(F.col("_size") * F.lit(float(share)))
    return placed.where(taken).drop("_k", "_size")


def first_per_draw(rows: DataFrame, cells: Sequence[str], replicates: int, most: int, salt: str = "draw") -> DataFrame:
    """For each draw and cell the first `most` persons of a random order in each task, with `replicate` and `_u`.

    `_u` orders as `uniform(person, replicate, salt)` does. A task keeps the persons that any draw still needs and their
    numbers, so its memory is bounded by cells x draws x `most`, not by its rows.
    """
    fields = rows.schema.fields
    schema = T.StructType([*fields, T.StructField("replicate", T.IntegerType()), T.StructField("_u", T.LongType())])
    tails = [f"|{r}|{salt}".encode() for r in range(1, replicates + 1)]

    def numbers(person: object) -> list[int]:
        head = hashlib.md5(str(person).encode())
        found = []
        for tail in tails:
            h = head.copy()
            h.update(tail)
            found.append(int.from_bytes(h.digest()[:4], "big"))
        return found

    def first(u: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of each column the first `most` places, by number and person; (most or fewer, draws)."""
        return np.stack([np.lexsort((ids, column))[:most] for column in u.T], axis=1)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, tuple[pa.Table, np.ndarray]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            places = table.select(cells).append_column("_at", pa.array(np.arange(table.num_rows))).group_by(cells).aggregate([("_at", "list")])
            for line in places.to_pylist():
                cell = tuple(line[c] for c in cells)
                new = table.take(pa.array(line["_at_list"]))
                u = np.array([numbers(x) for x in new[PERSON].to_pylist()], dtype=np.int64)
                if cell in state:
                    old, old_u = state[cell]
                    new, u = pa.concat_tables([old, new]), np.concatenate([old_u, u])
                if len(u) > most:
                    used = np.unique(first(u, np.asarray(new[PERSON])))
                    new, u = new.take(pa.array(used)).combine_chunks(), u[used]
                state[cell] = new, u
        for table, u in state.values():
            at = first(u, np.asarray(table[PERSON]))
            for r in range(replicates):
                out = table.take(pa.array(at[:, r]))
                out = out.append_column("replicate", pa.array(np.full(len(at), r + 1, dtype=np.int32)))
                yield from out.append_column("_u", pa.array(u[at[:, r], r])).combine_chunks().to_batches()

    return rows.mapInArrow(keep, schema)


def repeated_draws(binned: DataFrame, plan: DataFrame, replicates: int, share: float, total: int) -> DataFrame:
    """The persons of all draws, with `replicate` and whether they take part (`taken`); a table of its own.

    A bin gives a site at most half of `total`, the bound of what a task keeps.
    """
    cell = ["group", "site"]
    first = first_per_draw(binned, cell, replicates, max(1, int(total / len(SITES))))
    order = Window.partitionBy("replicate", *cell).orderBy("_u", PERSON)
    first = first.withColumn("_k", F.row_number().over(order)).join(F.broadcast(by_site(plan)), cell)  # two rows per bin
    drawn = first.where(F.col("_k") <= F.floor("n")).drop("_k", "_u", "n", "max_n")
    # a draw has at most `total` persons
    one = Window.partitionBy("replicate")
    place = F.row_number().over(one.orderBy(uniform(PERSON, "replicate", salt="take"), PERSON))
    size = F.count(F.lit(1)).over(one)
    return stage(drawn.withColumn("taken", place <= F.floor(size * F.lit(float(share)))))


METRIC_NAMES = ("auc", "avg_prec", "brier", "logloss")


def draw_metrics(binned: DataFrame, drawn: DataFrame, score: str = "prob", label: str = "y") -> DataFrame:
    """Metrics of all, binned, sampled, participating and binned participating rows."""

    def parts(df: DataFrame, replicate: Column, found: Mapping[str, Column]) -> DataFrame:
        lines = [F.struct(F.lit(name).alias("type"), value.alias("score")) for name, value in found.items()]
        return df.select(replicate.alias("replicate"), label, F.inline(F.array(*lines))).where("score is not null")

    taken = F.col("taken")
    rows = parts(binned, F.lit(0), {"All": F.col(score), "Binned": F.col("mid")}).unionByName(
        parts(
            drawn,
            F.col("replicate"),
            {
                "Sampled": F.col(score),
                "Sampled&Participation": F.when(taken, F.col(score)),
                "Sampled&Participation&Binned": F.when(taken, F.col("mid")),
            },
        )
    )
    keys = ["type", "replicate"]
    y, p, w = F.col(label).cast("double"), F.col("score"), F.lit(1)
    plain = rows.groupBy(*keys).agg(
        metrics.brier(y, p, w).alias("brier"), metrics.log_loss(y, p, w).alias("logloss")
    )
    both = metrics.ranked_metrics(rows, keys, "score", label).join(plain, keys)
    grouped = both.groupBy("type").agg(
        *[F.avg(m).alias(f"{m}_mean") for m in METRIC_NAMES],
        *[bootstrap.sorted_replicates(m).alias(f"_{m}") for m in METRIC_NAMES],
    )
    bounds = {}
    for m in METRIC_NAMES:
        bounds[f"{m}_low"] = bootstrap.at_share(F.col(f"_{m}"), 0.025)
        bounds[f"{m}_high"] = bootstrap.at_share(F.col(f"_{m}"), 0.975)
    return grouped.withColumns(bounds).drop(*[f"_{m}" for m in METRIC_NAMES])


def selection_stats(drawn: DataFrame, plan: DataFrame, label: str = "y") -> DataFrame:
    """Per bin: selected, planned and possible rows and the abnormal rate of participants."""
    per = drawn.groupBy("replicate", "group", "cut", "mid").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(F.when(F.col("taken"), F.col(label))), F.lit(0.0)).alias("rate"),
    )
    stats = per.groupBy("group", "cut", "mid").agg(
        F.min("n").alias("min_selected"),
        F.avg("n").alias("mean_selected"),
        F.avg("rate").alias("mean_rate"),
        F.sort_array(F.collect_list("rate")).alias("_r"),
    )
    table = plan.select("group", F.col("n").alias("planned"), (F.col("capacity") * len(SITES)).alias("possible"))
    low, high = bootstrap.at_share(F.col("_r"), 0.025), bootstrap.at_share(F.col("_r"), 0.975)
    return (
        stats.join(F.broadcast(table), "group")  # one row per bin
        .withColumns(
            {
                "rate_below": F.col("mean_rate") - low,
                "rate_above": F.greatest(high - F.col("mean_rate"), F.lit(0.0)),
                "share_of_possible": F.try_divide(F.col("mean_selected"), F.col("possible")),
            }
        )
        .drop("_r")
    )


def draw_boxes(drawn: DataFrame, values: Sequence[str]) -> DataFrame:
    """Per bin and value: median, quartiles and 2.5/97.5 percent points of a draw's participants, averaged over the draws.

    Draws without participants in a bin do not count there. A draw's bin has at most the plan's persons.
    """
    per = drawn.where("taken").groupBy("replicate", "group", "mid")
    per = per.agg(*[F.sort_array(F.collect_list(F.col(v).cast("double"))).alias(v) for v in values])

    def points(v: str) -> Column:
        last = F.size(v) - 1
        middle = (F.get(v, F.floor(last / 2).cast("int")) + F.get(v, F.ceil(last / 2).cast("int"))) / 2
        near = [F.get(v, F.floor(last * F.lit(q) + 0.5).cast("int")).alias(name) for name, q in BOX_POINTS.items()]
        return F.struct(F.lit(v).alias("variable"), middle.alias("median"), *near)

    long = per.select("group", "mid", F.inline(F.array(*[points(v) for v in values])))
    return long.groupBy("group", "mid", "variable").agg(*[F.avg(c).alias(c) for c in ("median", *BOX_POINTS)])


def bin_group_stats(binned: DataFrame, label: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Rows, abnormal rows and percent per bin."""
    return binned.groupBy(*keys, "group", "cut", "mid").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(label).alias("n_abnormal"),
        (F.sum(label) / F.count(F.lit(1))).alias("share"),
    )


BOX_POINTS = {"q1": 0.25, "q3": 0.75, "whisker_low": 0.025, "whisker_high": 0.975}


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and nearest-rank quartiles and 2.5/97.5 percent points per group."""
    return quantiles(df, keys, value, {"median": 0.5}, nearest=BOX_POINTS)
