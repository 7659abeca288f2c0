"""Cleaning of standard transactions; all steps are narrow."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronmap.functions.coerce import as_number, as_timestamp, in_range, is_known, is_not_blank
from patronmap.schema import AMOUNT, CUSTOMER, DATE


def coerce(df: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """Dates to TIMESTAMP and amounts to numbers; what cannot be read becomes null."""
    return df.withColumns(
        {
            DATE: as_timestamp(F.col(DATE), df.schema[DATE].dataType, formats),
            AMOUNT: as_number(F.col(AMOUNT), df.schema[AMOUNT].dataType),
        }
    )


def clean_light(df: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """Coerce, then drop rows without customer, date or amount (NaN counts as missing).

    Negative amounts and blank customers stay: trends and reports see returns too. Dates that
    do not fit into 64-bit nanoseconds are missing, whatever the column's type.
    """
    kept = drop_missing(coerce(df, formats), CUSTOMER, DATE, AMOUNT)
    dates = isinstance(df.schema[DATE].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return kept.where(in_range(F.col(DATE))) if dates else kept


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of `columns` is null or NaN."""
    known = (is_known(F.col(c), df.schema[c].dataType) for c in columns)
    return df.where(reduce(lambda a, b: a & b, known))


def clean(df: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """Light cleaning, then positive amounts and customers that are not blank only."""
    kept = clean_light(df, formats).where(F.col(AMOUNT) > 0)
    return kept.where(is_not_blank(F.col(CUSTOMER), df.schema[CUSTOMER].dataType))


def date_range(df: DataFrame, start: str, end: str, end_of_day: bool = False) -> DataFrame:
    """Rows from `start` to `end`, both dates.

    `end` means its midnight, so later rows of that day are out, unless `end_of_day`.
    """
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    if end_of_day:
        upper = F.col(DATE) < F.date_add(last, 1).cast("timestamp")
    else:
        upper = F.col(DATE) <= last
    return df.where((F.col(DATE) >= first) & upper)
