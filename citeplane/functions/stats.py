"""Ratios, intervals, percentiles and regression slack."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: The normal quantile of a 95 % interval, and the rounding allowed to a regression boundary.
Z95, ULPS = 1.959963984540054, 8


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def wilson(successes: Column, trials: Column, z: float = Z95) -> Column:
    """struct(low, high) within 0 to 1; null without trials."""
    n, p = trials.cast("double"), F.try_divide(successes.cast("double"), trials.cast("double"))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / scale
    return F.when(trials > 0, F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high")))


def percentile(values: Column | str, q: float) -> Column:
    """Interpolated at q * (n - 1)."""
    return F.percentile(values, q)


@F.pandas_udf(T.DoubleType())
def slack(a: pd.Series, b: pd.Series) -> pd.Series:
    """Rounding allowed between two values: some units in the last place of the larger one, or of 1."""
    return pd.Series([ULPS * math.ulp(max(1.0, abs(x), abs(y))) if x == x and y == y else None for x, y in zip(a, b)], dtype="float64")


def tolerance(override: Column, denominator: Column, below: Column, low_support: Column, default: Column) -> Column:
    """A metric's own tolerance, else the one of low support, else the default."""
    return F.coalesce(override, F.when(denominator < below, low_support), default)
