"""Feature assembly: a long store of (person, group, feature, value), its catalog, and vectors or columns from it.

Sources of any shape become rows of one store. Statistics of every feature (persons, sum, whether it has 0 and 1 only)
are one aggregation over it; leakage and rarity are decided in this catalog, which also gives each feature its place.
Rows then meet their person once and become a sparse vector of places and values, or named columns. A wide table
of all features never exists, so tens of thousands of codes cost rows, not columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labtrail.operators.series import PERSON
from labtrail.session import stage


@dataclass(frozen=True)
class Source:
    """Features of a group.

    `rows` are long (person, `feature`, `value`) or wide, a numeric column for each feature. `absent` is the
    value of a person without one (None: missing). A feature needs a sum of `least` over the cohort. Features whose
    name up to the first underscore is in `leaking` restate the goal and are left out.
    """

    group: str
    rows: DataFrame
    absent: float | None = None
    least: float | None = None
    leaking: Sequence[str] = ()

    @property
    def long(self) -> bool:
        return {"feature", "value"} <= set(self.rows.columns)

    def features(self, only: Sequence[str] | None) -> list[str]:
        """Columns of a wide source."""
        numeric = (T.NumericType, T.BooleanType)
        found = [f.name for f in self.rows.schema if f.name != PERSON and isinstance(f.dataType, numeric)]
        return found if only is None else [x for x in found if x in set(only)]

    def store(self, only: Sequence[str] | None = None) -> DataFrame | None:
        """Known values as rows; of `only` these features, if given."""
        if self.long:
            rows = self.rows.select(PERSON, F.col("feature").cast("string"), F.col("value").cast("double"))
            rows = rows if only is None else rows.where(F.col("feature").isin(list(only)))
        else:
            names = self.features(only)
            if not names:
                return None
            lines = [F.struct(F.lit(x).alias("feature"), F.col(f"`{x}`").cast("double").alias("value")) for x in names]
            rows = self.rows.select(PERSON, F.inline(F.array(*lines)))
        return rows.where(F.col("value").isNotNull() & ~F.isnan("value")).select(PERSON, F.lit(self.group).alias("group"), "feature", "value")


def store(labels: DataFrame, sources: Sequence[Source], only: Sequence[str] | None = None) -> DataFrame:
    """Rows of all sources for the persons of `labels`."""
    parts = [p for p in (s.store(only) for s in sources) if p is not None]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.join(labels.select(PERSON).distinct(), PERSON, "left_semi")


def _by_group(sources: Sequence[Source], value) -> Column:
    """A literal of each source, by the group of a row."""
    out = F.lit(None)
    for s in sources:
        out = F.when(F.col("group") == s.group, value(s)).otherwise(out)
    return out


def catalog(rows: DataFrame, sources: Sequence[Source], needed: Sequence[str] = ()) -> DataFrame:
    """A row for each feature that stays: `place`, `group`, `feature`, `n_person`, `total`, `is_binary`, `absent`.

    Groups come in the order of `sources`, features by name. A needed feature that no row has is a constant 0.
    """
    stats = rows.groupBy("group", "feature").agg(
        F.count(F.lit(1)).alias("n_person"),
        F.sum("value").alias("total"),
        F.bool_and(F.col("value").isin(0.0, 1.0)).alias("is_binary"),
    )
    keep = F.coalesce(F.col("total") >= _by_group(sources, lambda s: F.lit(s.least)).cast("double"), F.lit(True))
    for s in sources:
        if s.leaking:
            keep = keep & ~((F.col("group") == s.group) & F.substring_index("feature", "_", 1).isin(list(s.leaking)))
    stats = stats.where(keep).withColumns(
        {
            "absent": _by_group(sources, lambda s: F.lit(s.absent)).cast("double"),
            "_group": _by_group(sources, lambda s: F.lit([x.group for x in sources].index(s.group))).cast("int"),
        }
    )
    if needed:
        # a row for each needed name
        wanted = rows.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(needed)], "feature string")
        missing = wanted.join(stats.select("feature"), "feature", "left_anti")
        added = missing.select(
            F.lit("needed").alias("group"), "feature", F.lit(0).cast("long").alias("n_person"), F.lit(0.0).alias("total"),
            F.lit(True).alias("is_binary"), F.lit(0.0).alias("absent"), F.lit(len(sources)).alias("_group"),
        )
        stats = stats.unionByName(added)
    # one row per feature, as many as a schema has
    place = F.row_number().over(Window.orderBy("_group", "feature")) - 1
    return stats.withColumn("place", place).drop("_group")


def vectors(labels: DataFrame, rows: DataFrame, features: DataFrame) -> DataFrame:
    """Distinct rows of `labels` with `places` and `vals`, the known values of each person by place.

    What is not listed has the feature's `absent` value. A person has at most as many entries as there are features.
    """
    placed = rows.join(features.select("group", "feature", "place"), ["group", "feature"])
    entries = placed.groupBy(PERSON).agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("_entries"))
    found = labels.distinct().join(entries, PERSON, "left")
    empty = F.coalesce("_entries", F.array().cast("array<struct<place:int,value:double>>"))
    return found.withColumns({"places": empty["place"], "vals": empty["value"]}).drop("_entries")


def columns(
    labels: DataFrame, rows: DataFrame, absent: Mapping[str, float | None], needed: Sequence[str] = ()
) -> DataFrame:
    """Distinct rows of `labels` with the named features as columns, from one pivot without a look at the data.

    `absent` has each feature and the value of a person without it; `needed` ones that have no source are 0.
    """
    chosen = [F.max(F.when(F.col("feature") == x, F.col("value"))).alias(x) for x in absent]
    wide = rows.where(F.col("feature").isin(list(absent))).groupBy(PERSON).agg(*chosen)
    out = labels.distinct().join(wide, PERSON, "left")
    filled = {x: F.coalesce(F.col(f"`{x}`"), F.lit(v)) for x, v in absent.items() if v is not None}
    constant = {x: F.lit(0.0) for x in needed if x not in absent}
    return out.withColumns(filled | constant) if filled or constant else out


def assembled(
    labels: DataFrame, sources: Sequence[Source], needed: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The store as a written table, its catalog, and the persons' vectors."""
    rows = stage(store(labels, sources))
    features = stage(catalog(rows, sources, needed))
    return rows, features, vectors(labels, rows, features)
