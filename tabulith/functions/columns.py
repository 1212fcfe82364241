"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Category that stands for a null where nulls count as a category.
MISSING = "__MISSING__"


def let(value: Column, f) -> Column:
    """f(value), with the value computed once; a column named inside a lambda may be inlined and computed for each element."""
    return F.transform(F.array(value), f)[0]


def uniform(seed: int, key: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed|key): the same under any partitioning."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def hash_order(seed: int, key: Column | str) -> Column:
    """A sort key that shuffles rows in a way that depends on seed and key only."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def canonical(value: Column, kind: str = "string") -> Column:
    """A value as a category name: whole numbers look the same whether read as integers or as floats."""
    if kind in ("double", "float"):
        return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def or_missing(value: Column) -> Column:
    return F.coalesce(value, F.lit(MISSING))


def to_numeric(value: Column) -> Column:
    """Numbers from text; what is no number becomes null."""
    return value.cast("string").try_cast("double")


def finite(value: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def round_half_even(value: Column) -> Column:
    return F.bround(value, 0)
