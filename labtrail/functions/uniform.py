"""Reproducible uniform numbers, independent of partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*ids: Column | str, salt: str) -> Column:
    """Number in [0, 1) that depends only on the id columns and the salt."""
    parts = [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: A prime below 2**31, so products stay below 2**62, and the numbers of the mix's rounds:
#: (factor, step of the factor per replicate, step of the sum per replicate, step per high part).
MIX_PRIME = 2147483647
MIX_ROUNDS = {
    "a": ((73244475, 69621, 1103515, 48271), (40692013, 39373, 742938, 16807), (1389796, 22937, 630360, 7919)),
    "b": ((62089911, 30001, 847861, 45991), (37769685, 68041, 925333, 10007), (9457813, 51151, 271828, 6101)),
}
LOW_BITS = 30
DRAW_BITS = 62


def mixed_draw(first: Column, replicate: Column) -> dict[str, Column]:
    """Steps that make `_draw`, a number below 2**62, from a non-negative integer and a replicate.

    Two streams of 31 bits. The replicate is part of every round's factor and sum, so the streams of
    two replicates are different functions of the place, not shifts of one another. Integer
    arithmetic only; apply the steps in order with `with_draw`.
    """
    low, high = first.bitwiseAND((1 << LOW_BITS) - 1), F.shiftright(first, LOW_BITS)
    steps = {}
    for stream, rounds in MIX_ROUNDS.items():
        name = f"_mix_{stream}"
        steps[f"{name}0"] = low % MIX_PRIME
        for k, (factor, by_factor, by_sum, by_high) in enumerate(rounds):
            h = F.col(f"{name}{k}")
            h = h.bitwiseXOR(F.shiftright(h, 15))
            keyed = (F.lit(factor).cast("long") + replicate * by_factor) % MIX_PRIME
            steps[f"{name}{k + 1}"] = (h * keyed % MIX_PRIME + replicate * by_sum + high * by_high + 11 * (k + 1)) % MIX_PRIME
    last = len(MIX_ROUNDS["a"])
    steps["_draw"] = F.col(f"_mix_a{last}") * F.lit(1 << 31) + F.col(f"_mix_b{last}")
    return steps


def with_draw(df: DataFrame, first: str, replicate: str) -> DataFrame:
    """Add `_draw`, a number below 2**62 that depends on two integer columns only."""
    steps = mixed_draw(F.col(first).cast("long"), F.col(replicate).cast("long"))
    names = df.columns
    for name, column in steps.items():
        df = df.withColumn(name, column)
    return df.select(*names, "_draw")


def row_number_of(*ids: Column | str, salt: str) -> Column:
    """Integer with 60 bits that depends only on the id columns and the salt."""
    parts = [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(salt)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def poisson_limits(most: int = 20) -> list[int]:
    """Draws from which on the weight of a row is at least 1, 2, ...: Poisson with mean 1."""
    limits, term, total = [], math.exp(-1.0), 0.0
    for k in range(most):
        total += term
        limits.append(int(total * (1 << DRAW_BITS)))
        term /= k + 1
    return [x for x in limits if x < (1 << DRAW_BITS) - (1 << 40)]
