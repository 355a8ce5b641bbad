"""Weighted collections: DataFrames whose rows carry an integer weight.

A weight of 1 is a row, -1 takes a row away; rows of the same values add up
and vanish at 0.  Grouping is null-safe, so a null equals a null here, though
it never matches in a join.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHT = "_z_weight"


class IntegrityError(ValueError):
    """A change takes away what is not there."""


def values(df: DataFrame) -> list[str]:
    """Columns besides the weight."""
    return [c for c in df.columns if c != WEIGHT]


def weighted(df: DataFrame, weight: int = 1) -> DataFrame:
    """df with weights; rows that have one keep it."""
    return df if WEIGHT in df.columns else df.withColumn(WEIGHT, F.lit(weight).cast("long"))


def negate(z: DataFrame) -> DataFrame:
    return z.withColumn(WEIGHT, -F.col(WEIGHT))


def add(parts: Iterable[DataFrame | None]) -> DataFrame | None:
    """The sum, not consolidated; None stands for an empty collection."""
    held = [p for p in parts if p is not None]
    return reduce(lambda a, b: a.unionByName(b), held) if held else None


def consolidate(z: DataFrame) -> DataFrame:
    """One row for each distinct value with its total weight; zeros go."""
    cols = values(z)
    total = F.sum(WEIGHT).alias(WEIGHT)
    return (z.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(total) if cols else z.agg(total)).where(F.col(WEIGHT) != 0)


def difference(new: DataFrame | None, old: DataFrame | None) -> DataFrame | None:
    """What turns old into new."""
    total = add([new, negate(old) if old is not None else None])
    return consolidate(total) if total is not None else None


def expand(z: DataFrame) -> DataFrame:
    """The bag: each row as often as its weight says."""
    repeated = F.explode(F.array_repeat(F.lit(0), F.col(WEIGHT).cast("int"))).alias("_copy")
    once = z.select(*values(z), F.when(F.col(WEIGHT) != 1, F.col(WEIGHT)).otherwise(1).alias(WEIGHT))
    return once.select(*values(z), repeated).drop("_copy")


def checked(z: DataFrame, what: str) -> DataFrame:
    """z, which must have no negative weight once it is read."""
    bad = F.raise_error(F.lit(f"{what}: a change takes away a row that is not there"))
    return z.withColumn(WEIGHT, F.when(F.col(WEIGHT) < 0, bad.cast("long")).otherwise(F.col(WEIGHT)))


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose key is in right, null-safe.  right has the key columns alone, in the same order."""
    renamed = right.toDF(*[f"_k{i}" for i in range(len(keys))])
    on = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, on, "left_semi")
