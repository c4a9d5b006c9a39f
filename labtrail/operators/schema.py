"""Column types, projections and feature lists of wide tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID = "person_id"
_WIDTH = {
    T.ByteType(): 10,
    T.ShortType(): 11,
    T.IntegerType(): 12,
    T.LongType(): 13,
    T.FloatType(): 20,
    T.DoubleType(): 21,
    T.StringType(): 30,
}


def common_types(frames: Iterable[DataFrame]) -> dict[str, T.DataType]:
    """Widest type per column: text over floating point over integer."""
    found: dict[str, T.DataType] = {}
    for frame in frames:
        for field in frame.schema:
            old = found.get(field.name)
            if old is None or _WIDTH.get(field.dataType, 0) > _WIDTH.get(old, 0):
                found[field.name] = field.dataType
    return found


def promote_union(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL after casting every column to its common type (failures are null)."""
    wanted = common_types(frames)
    aligned = [
        f.withColumns({c: F.col(c).try_cast(wanted[c]) for c in f.columns}) for f in frames
    ]
    return reduce(lambda a, b: a.unionByName(b), aligned)


def narrow_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0/1 columns to one byte, other integers to double, NaN to null.

    One aggregation looks at all columns; one row reaches the driver.
    """
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    values = {c: F.col(f"`{c}`").try_cast("double") for c in columns}
    other = df.agg(
        *[
            F.max(F.when(F.isnan(v) | v.isin(0.0, 1.0), 0).when(v.isNotNull(), 1)).alias(c)
            for c, v in values.items()
        ]
    ).first()
    text_bad = {f.name for f in df.schema if not isinstance(f.dataType, T.NumericType)}
    casts = {}
    for c, v in values.items():
        if not other[c] and c not in text_bad:
            casts[c] = F.when(~F.isnan(v), v).cast("tinyint")
        elif isinstance(df.schema[c].dataType, whole):
            casts[c] = v
    return df.withColumns(casts)


def ensure_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    """Add missing columns as 0 and drop repeated rows."""
    missing = {c: F.lit(0) for c in needed if c not in df.columns}
    return (df.withColumns(missing) if missing else df).distinct()


def prefix_second(df: DataFrame, keys: Sequence[str] = (ID,)) -> DataFrame:
    """Prefix every column but the keys with S_."""
    return df.withColumnsRenamed({c: f"S_{c}" for c in df.columns if c not in keys})


_NOT_FEATURES = {ID, "SET", "split_set", "y_mean_abnorm", "LAST_CODE_DATE", "LAST_VAL_DATE", "S_LAST_VAL_DATE"}


def feature_groups(wanted: Sequence[str], available: Mapping[str, Sequence[str]]) -> list[str]:
    """Expand group names to column names; other names stay.

    Groups: ICD_MAT, ATC_MAT, SUMSTATS, SECOND_SUMSTATS, LAB_MAT, TRANSFORMER;
    a group name with the ending _MEAN keeps only the columns of means.
    """
    out: list[str] = []
    for name in wanted:
        group = name.removesuffix("_MEAN")
        if name in available:
            out += [c for c in available[name] if c not in _NOT_FEATURES]
        elif name != group and group in available:
            out += [c for c in available[group] if c not in _NOT_FEATURES and "MEAN" in c]
        else:
            out.append(name)
    return out


# fixed values: lab concepts that restate the predicted lab, by strictness
RESTATING = {
    "egfr": {0: ["40764999", "46236952", "3020564"], 1: ["40764999", "46236952", "3020564", "3030366", "3020682"]},
    "hba1c": {0: ["3004410", "3018251"], 1: ["3004410", "3018251", "3013826"]},
    "tsh": {0: ["3009201", "3008486"], 1: ["3009201", "3008486", "3026989"]},
    "ldl": {
        0: ["3001308", "3048773", "3025839"],
        1: ["3001308", "3019900", "3023602", "42868674", "3048773", "3025839"],
    },
}
RESTATING["krea"] = RESTATING["egfr"]
OWN_CONCEPT = {"hba1c": ["3004410"], "tsh": ["3009201"], "ldl": ["3001308"]}


def restating(lab: str, strict: int = 1, single_concept: bool = False) -> list[str]:
    """Concepts that restate a lab; `single_concept` is the release in which each lab has one concept only."""
    drop = RESTATING[lab][int(bool(strict))]
    return OWN_CONCEPT.get(lab, drop) if single_concept else drop


def leakage_exclude(
    labs: DataFrame, lab: str, strict: int = 1, single_concept: bool = False, column: str = "lab"
) -> DataFrame:
    """Long lab features without those that restate the predicted lab."""
    return labs.where(~F.col(column).isin(restating(lab, strict, single_concept)))
