"""Recoding of flags, units, registry values and predictor names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: result flags and their order
FLAG_ORDER = {"N": 0, "L": -1, "H": 1, "LL": -2, "HH": 2}
# fixed values: spellings of the thyroid unit
THYROID_UNITS = ("u/l", "iu/l")
# fixed values: smoking status groups
SMOKING = {0: ("NO", "NEVER", "PASSIVE"), 1: ("FORMER", "EVER"), 2: ("CURRENT",)}
# fixed values: half-open age bands, the last one closed
AGE_BANDS = [(30, 40), (40, 50), (50, 60), (60, 70)]


def lookup(column: Column, table: Mapping, otherwise: Column | None = None) -> Column:
    """Value of a short fixed table; null (or `otherwise`) for other keys."""
    out = None
    for key, value in table.items():
        out = (F if out is None else out).when(column == F.lit(key), F.lit(value))
    return out.otherwise(otherwise) if otherwise is not None else out


def thyroid_unit(unit: Column) -> Column:
    return F.when(unit.isin(*THYROID_UNITS), "mu/l").otherwise(unit)


def plain_flag(flag: Column, doubled: bool = False) -> Column:
    """A becomes H; with `doubled` AA becomes HH as well."""
    out = F.when(flag == "A", "H")
    if doubled:
        out = out.when(flag == "AA", "HH")
    return out.otherwise(flag)


def ordinal_flag(flag: Column) -> Column:
    return lookup(flag, FLAG_ORDER).cast("double")


def simple_flag(flag: Column) -> Column:
    return F.when(flag == "N", 0).when(flag.isNotNull(), 1)


def three_level_flag(flag: Column) -> Column:
    return lookup(flag, {k: FLAG_ORDER[k] for k in ("N", "L", "H")})


def age_band(age: Column) -> Column:
    out = None
    for low, high in AGE_BANDS:
        top = age <= high if (low, high) == AGE_BANDS[-1] else age < high
        out = (F if out is None else out).when((age >= low) & top, f"{low}-{high}")
    return out


def sex_binary(sex: Column, is_text: bool = True) -> Column:
    return lookup(sex, {"female": 0, "male": 1}).cast("int") if is_text else sex.cast("int")


def smoking_status(status: Column) -> Column:
    out = None
    for value, names in SMOKING.items():
        out = (F if out is None else out).when(status.isin(*names), value)
    return out


def education_level(code: Column) -> Column:
    """First digit of the education code."""
    return F.substring(code, 1, 1).try_cast("int")


def education_binary(level: Column) -> Column:
    return F.when(level <= 4, 0).otherwise(1)


def one_vs_rest(label: Column, positive: int = 1) -> Column:
    return F.when(label == positive, 1).otherwise(0)


def any_risk(label: Column) -> Column:
    return F.when(label == 0, 0).otherwise(1)


def fixed_set(split_set: Column) -> Column:
    """Fine-tuning rows count as training rows."""
    return F.when(split_set == 0.5, 0.0).otherwise(split_set)


def small_to_zero(count: Column, limit: int = 5) -> Column:
    return F.when(count <= limit, 0).otherwise(count)


def class_code(label: Column) -> Column:
    """Class -1 is recoded to 2 for multi-class fitting."""
    return F.when(label == -1, 2).otherwise(label)


# fixed values: predictor sets named by model id
PREDICTOR_SETS = {
    "xgb_logloss_3_registry": "registry data",
    "xgb_logloss_3_otherlabs": "other labs",
    "xgb_logloss_2_sumstats": "sumstats",
    "xgb_logloss_4_all": "all data",
    "xgb_logloss_5_all_pgs": "all data + PGS",
    "maxim": "maxim",
}
# fixed values: the order in which predictor sets are compared
PREDICTOR_LEVELS = [
    "baseline",
    "registry data",
    "other labs",
    "last value",
    "sumstats",
    "all data",
    "all data + PGS",
    "maxim",
]


def predictor_set(model: Column, lab: Column) -> Column:
    """Readable predictor set of a model id; the baseline model depends on the lab."""
    name = F.regexp_replace(model, "mlogloss", "logloss")
    baseline = ((name == "lr_logloss_0_base") & (lab != "TSH")) | (
        (name == "xgb_logloss_1_clinpheno") & (lab == "TSH")
    )
    out = F.when(baseline, "baseline")
    for key, value in PREDICTOR_SETS.items():
        out = out.when(name == key, value)
    return out


def first_of(names: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(n) for n in names])
