"""Order-free, exactly rounded sums of doubles, with bounded state.

A double is a whole number of 2**(exponent - 54) units. Units of one exponent are
added as exact decimals by an ordinary partial aggregate, and at most some two
thousand exponents exist; a group's few sums are then added as fractions and
rounded once, in an Arrow-batched function.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _scaled(value: Column, power: Column) -> Column:
    """value * 2**power without an overflow on the way."""
    half = F.floor(power / 2)
    return value * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


def exponent(value: Column) -> Column:
    return F.when(value == 0, F.lit(0)).otherwise(F.greatest(F.floor(F.log2(F.abs(value))), F.lit(-1000))).cast("int")


def units(value: Column) -> Column:
    """The double as a whole number of units of 2**(exponent - 54)... with 128 more for the smallest ones."""
    return _scaled(value, F.lit(54) - exponent(value)).cast("bigint").cast("decimal(38,0)")


@F.pandas_udf(T.DoubleType())
def rounded(parts: pd.Series) -> pd.Series:
    """Adds array<struct<exponent, units>> exactly and rounds once; None without parts, infinity beyond the range."""

    def one(items):
        if items is None or len(items) == 0:
            return None
        total = sum((Fraction(int(p["units"])) * Fraction(2) ** (int(p["exponent"]) - 54) for p in items), Fraction(0))
        try:
            return float(total)
        except OverflowError:
            return float("inf") if total > 0 else float("-inf")

    return parts.map(one)


def exact_sums(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the exact sum of a double column; nulls are skipped, a group without values has null."""
    used = df.where(F.col(value).isNotNull())
    first = used.groupBy(*keys, exponent(F.col(value)).alias("exponent")).agg(F.sum(units(F.col(value))).alias("units"))
    parts = first.groupBy(*keys).agg(F.collect_list(F.struct("exponent", F.col("units").cast("string").alias("units"))).alias("parts"))
    return parts.select(*keys, rounded("parts").alias(name))
