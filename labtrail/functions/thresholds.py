"""Abnormality rules per laboratory test, as Column builders.

Each rule maps (value, age) to ABNORM_CUSTOM. A comparison with a null value is
not true, so a null falls to the last branch unless the rule says otherwise.
The cut-offs are fixed values; results must equal published practice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def _flag(high: Column | None = None, low: Column | None = None) -> Column:
    """1 where `high` holds, otherwise -1 where `low` holds, otherwise 0."""
    out = F.when(F.lit(False), F.lit(0.0))
    if high is not None:
        out = out.when(high, 1.0)
    if low is not None:
        out = out.when(low, -1.0)
    return out.otherwise(0.0)


def _kidney_grey(upper: float) -> Rule:
    return lambda v, age: (
        F.when(v < 60, 1.0).when((v >= 60) & (v <= upper), 0.5).otherwise(0.0)
    )


# age from, age below, filtration rate below which the result is abnormal
KIDNEY_AGE_LIMITS = [
    (None, 40, 60),
    (30, 40, 75),
    (40, 50, 70),
    (50, 60, 60),
    (60, 70, 50),
    (70, 80, 40),
    (80, None, 35),
]


def _kidney_by_age(v: Column, age: Column) -> Column:
    hit = F.lit(False)
    for start, stop, limit in KIDNEY_AGE_LIMITS:
        test = v < limit
        if start is not None:
            test = test & (age >= start)
        if stop is not None:
            test = test & (age < stop)
        hit = hit | F.coalesce(test, F.lit(False))
    return _flag(hit)


def _kidney_two_ages(v: Column, age: Column) -> Column:
    years = F.floor(age)
    return _flag(((years < 60) & (v < 60)) | ((years >= 60) & (v < 50)))


def _cystatin(v: Column, age: Column) -> Column:
    young = (v > 1) & (age <= 50)
    return F.when(young | (v > 1.2), 1.0).when(v <= 1.2, 0.0)


def _albumin_ratio(v: Column, age: Column) -> Column:
    # exactly 3 and null belong to the last class
    return (
        F.when(v < 3, 0.0)
        .when((v > 3) & (v <= 30), 1.0)
        .when((v > 30) & (v <= 220), 2.0)
        .otherwise(3.0)
    )


def _above_or_null(limit: float) -> Rule:
    return lambda v, age: F.when(v > limit, 1.0).when(v <= limit, 0.0)


_KIDNEY: dict[str, Rule] = {
    "": lambda v, age: _flag(v < 60),
    "KDIGO-strict": lambda v, age: _flag(v < 60),
    "KDIGO-soft": _kidney_grey(65),
    "KDIGO-soft2": _kidney_grey(70),
    "herold-full": _kidney_by_age,
    "herold-part": _kidney_two_ages,
}
_THYROID: dict[str, Rule] = {
    "multi": lambda v, age: _flag(v >= 4, v < 0.4),
    "simple": lambda v, age: _flag(v > 4),
}
_SUGAR: dict[str, Rule] = {"soft": _above_or_null(42), "strong": _above_or_null(47)}
_GLUCOSE: Rule = lambda v, age: _flag(v >= 7, v < 4)
_FATS: Rule = lambda v, age: _flag(v > 2)

RULES: dict[str, dict[str, Rule]] = {
    "egfr": _KIDNEY,
    "krea": _KIDNEY,
    "tsh": _THYROID,
    "hba1c": _SUGAR,
    "cyst": {"": _cystatin},
    "cystc": {"": _cystatin},
    "leuk": {"": lambda v, age: _flag(v > 8.2, v < 3.4)},
    "tri": {"": _FATS},
    "ftri": {"": _FATS},
    "uacr": {"": _albumin_ratio},
    "gluc": {"": _GLUCOSE},
    "fgluc": {"": _GLUCOSE},
    "ldl": {"": lambda v, age: F.when(v < 4, 0.0).otherwise(1.0)},
    "t4": {"": lambda v, age: _flag(v > 23, v <= 9)},
    "t3": {"": lambda v, age: _flag(v > 6.3)},
    "ana": {"": lambda v, age: _flag(v > 400)},
    "alat": {"": lambda v, age: _flag(v > 45)},
    "asat": {"": lambda v, age: _flag(v > 35)},
}


def abnormal(lab: str, choice: str = "", value: str | Column = "value", age: str | Column = "event_age") -> Column:
    """ABNORM_CUSTOM of one laboratory test; ValueError where no rule is known.

    Tests with one rule ignore `choice`; kidney tests fall back to the strict rule.
    """
    choices = RULES.get(lab)
    if choices is None:
        raise ValueError(f"no abnormality rule for {lab!r}")
    if lab in ("egfr", "krea"):
        rule = choices.get(choice, choices[""])
    elif "" in choices:
        rule = choices[""]
    elif choice in choices:
        rule = choices[choice]
    else:
        raise ValueError(f"{lab!r} needs one of {sorted(choices)}, not {choice!r}")
    v = F.col(value) if isinstance(value, str) else value
    a = F.col(age) if isinstance(age, str) else age
    return rule(v, a)
