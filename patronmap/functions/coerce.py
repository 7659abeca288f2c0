"""Tolerant conversions: what cannot be read becomes null, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark reads Java number literals such as `1d`, `2.5F` or `0x1p3`; a data file means text by them.
JAVA_ONLY_NUMBER = r"(?i)([0-9.]\s*[df]|0x.*)\s*$"
# A bare time of day would be completed with today's date, and more digits taken for a year.
ISO_DATE = r"^\s*[0-9]{4}(\s*$|[-T])"
COMPACT_DATE = r"^\s*[0-9]{8}\s*$"
# Anything but white space, the ASCII separators included.
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


# The first and last moment, in whole microseconds, of 64-bit nanoseconds from 1970.
FIRST_MOMENT, LAST_MOMENT = "1677-09-21 00:12:43.145225Z", "2262-04-11 23:47:16.854775Z"


def as_timestamp(column: Column, dtype: T.DataType, formats: Sequence[str] = ()) -> Column:
    """Timestamp of a date, timestamp, number or text column.

    Text may be ISO 8601, with or without dashes, or follow any of `formats`; each row is
    read by itself. A number counts nanoseconds from 1970. Any other type has no dates. What does
    not fit into 64-bit nanoseconds, such as 9999-12-31 for an open end, is missing; dates and
    timestamps are passed on as they are, so that a scan can use filters on them, and
    `in_range` finds those.
    """
    moment = _moment(column, dtype, formats)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return moment
    # Bound once: a text would otherwise be parsed for every comparison.
    return F.transform(F.array(moment), lambda m: F.when(in_range(m), m))[0]


def in_range(moment: Column) -> Column:
    """Whether a timestamp fits into 64-bit nanoseconds."""
    first, last = (F.lit(m).cast("timestamp") for m in (FIRST_MOMENT, LAST_MOMENT))
    return moment.between(first, last)


def _moment(column: Column, dtype: T.DataType, formats: Sequence[str]) -> Column:
    if isinstance(dtype, T.StringType):
        iso = F.when(column.rlike(ISO_DATE), F.try_to_timestamp(column))
        compact = F.try_to_timestamp(F.trim(column), F.lit("yyyyMMdd"))
        compact = F.when(column.rlike(COMPACT_DATE), compact)
        others = (F.try_to_timestamp(column, F.lit(f)) for f in formats)
        return F.coalesce(iso, compact, *others)
    if isinstance(dtype, T.IntegralType):
        return F.timestamp_micros(F.call_function("div", column.cast("bigint"), F.lit(1000)))
    if isinstance(dtype, T.NumericType):
        known = F.when(is_known(column, dtype), F.floor(column / 1000))
        return F.timestamp_micros(known.try_cast("bigint"))
    if isinstance(dtype, T.TimestampType):
        return column
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return column.cast("timestamp")
    return F.lit(None).cast("timestamp")


def as_number(column: Column, dtype: T.DataType) -> Column:
    """Number of a text column; numeric columns keep their type, so decimals stay exact."""
    if isinstance(dtype, T.NumericType):
        return column
    text = column.cast("string")
    return F.when(~text.rlike(JAVA_ONLY_NUMBER), text.try_cast("double"))


def is_known(column: Column, dtype: T.DataType) -> Column:
    """Neither null nor NaN; as plain null checks, which a scan can use (`dropna` cannot)."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return column.isNotNull() & ~F.isnan(column)
    return column.isNotNull()


def is_not_blank(column: Column, dtype: T.DataType) -> Column:
    """True unless the value is text made of white space only; the value is not trimmed."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return column.rlike(NOT_BLANK)
    return column.isNotNull()
