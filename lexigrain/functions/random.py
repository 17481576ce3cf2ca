"""Deterministic pseudo-random expressions: functions of a key and a salt, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, *salt: int | str | Column) -> Column:
    """A number in [0, 1) from the upper 53 bits of a hash."""
    parts = [s if isinstance(s, Column) else F.lit(s) for s in salt]
    return F.shiftrightunsigned(F.xxhash64(key, *parts), 11).cast("double") / F.lit(float(1 << 53))


def between(key: Column, low: int, high: int, *salt: int | str | Column) -> Column:
    """A whole number from low to high, both included."""
    return (F.floor(uniform(key, *salt) * (high - low + 1)) + low).cast("int")


def weighted(u: Column, weights: dict) -> Column:
    """The value whose share of the unit interval holds u; None is a value as well."""
    total, below, out = sum(weights.values()), 0.0, None
    for value, weight in weights.items():
        below += weight / total
        hit = u < F.lit(below)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(value))


def pick(values: list[str], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))
