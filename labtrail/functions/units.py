"""Unit conversions and filtration-rate equations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def egfr_2021(creatinine: Column, sex: Column, age: Column, female_max_k: float = 0.9) -> Column:
    """CKD-EPI 2021 rate from creatinine in umol/l.

    `female_max_k` is the constant in the female maximum term: 0.9 keeps
    earlier results comparable, 0.7 is the published formula. Any other sex than "male"
    uses the female branch.
    """
    mg = creatinine / 88.4

    def rate(min_k: float, alpha: float, max_k: float) -> Column:
        low = F.pow(F.least(mg / min_k, F.lit(1.0)), F.lit(alpha))
        high = F.pow(F.greatest(mg / max_k, F.lit(1.0)), F.lit(-1.2))
        return 142 * low * high * F.pow(F.lit(0.9938), age)

    male, female = rate(0.9, -0.302, 0.9), rate(0.7, -0.241, female_max_k) * 1.012
    return F.when(creatinine.isNotNull(), F.when(sex == "male", male).otherwise(female))


def cystatin_2012(cystatin: Column, sex: Column, age: Column) -> Column:
    """CKD-EPI 2012 rate from cystatin C in mg/l."""
    ratio = cystatin / 0.8
    low = F.pow(F.least(ratio, F.lit(1.0)), F.lit(-0.499))
    high = F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(-1.328))
    rate = 133 * low * high * F.pow(F.lit(0.996), age)
    return F.when(cystatin.isNotNull(), F.when(sex == "male", rate).otherwise(rate * 0.932))


def hba1c_mmol(value: Column, unit: Column) -> Column:
    """Percent to mmol/mol, any other unit unchanged, rounded to whole numbers."""
    converted = F.when(unit == "%", 10.93 * value - 23.50).otherwise(value)
    return F.round(converted)


def filled_value(value: Column, flag: Column, dummies: Mapping[str, float]) -> Column:
    """Value of a flagged result without measurement; -1 leaves it missing."""
    out = F.when(value.isNotNull(), value)
    for name, dummy in dummies.items():
        if dummy != -1:
            out = out.when(flag == name, F.lit(float(dummy)))
    return out


def filled_unit(
    value: Column, flag: Column, unit: Column, dummies: Mapping[str, float], dummy_unit: str
) -> Column:
    """Unit of a filled result; only L, N and H receive one, -1 clears it."""
    out = F.when(value.isNotNull(), unit)
    for name in ("L", "N", "H"):
        if name in dummies:
            new = F.lit(dummy_unit) if dummies[name] != -1 else F.lit(None).cast("string")
            out = out.when(flag == name, new)
    return out.otherwise(unit)
