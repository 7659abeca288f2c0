"""Rounding, ratios and sums with the conventions the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def half_even(column: Column, digits: int = 2) -> Column:
    """Round a double half to even (`round` rounds half up)."""
    scale = 10.0**digits
    return F.rint(column * scale) / scale


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, null when the denominator is 0 or null."""
    bottom = denominator.cast("double")
    return F.when(bottom != 0, numerator.cast("double") / bottom)


def number_or_null(column: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(column), column)


def known_number(df: DataFrame, name: str) -> Column:
    """The column with NaN as null; types that have no NaN stay as they are."""
    fractional = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return number_or_null(F.col(name)) if fractional else F.col(name)


def double_text(value: float) -> str:
    """SQL text of a double; long generated expressions are quicker to build as text."""
    value = float(value)
    return f"{value!r}D" if math.isfinite(value) else f"CAST('{value}' AS DOUBLE)"
