"""Numeric helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(value: Column) -> Column:
    """Six decimals, ties to even."""
    return F.bround(value, 6)


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, 0 when the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def log2_floor(value: Column) -> Column:
    """floor(log2(value)) for integers, 0 for values up to 1."""
    return F.when(value <= 1, F.lit(0.0)).otherwise((F.length(F.bin(value)) - 1).cast("double"))


def log2_at_least(value: Column, floor: int) -> Column:
    return F.log2(F.greatest(value, F.lit(floor)).cast("double"))


def flag(condition: Column) -> Column:
    """1.0 / 0.0 indicator; NULL conditions count as 0."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def as_int(condition: Column) -> Column:
    """1 / 0 indicator as INT; NULL conditions count as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))
