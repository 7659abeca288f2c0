"""Calendar buckets: days, weeks ending on Sunday, calendar months."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_TEXT = "yyyy-MM"


@dataclass(frozen=True)
class Period:
    """`anchor` is the first day of the bucket, `label` the day that names it."""

    anchor: Callable[[Column], Column]
    step: str
    label: Callable[[Column], Column]


PERIODS = {
    "D": Period(F.to_date, "INTERVAL 1 DAY", lambda day: day),
    "W": Period(
        lambda moment: F.trunc(moment, "week"),
        "INTERVAL 7 DAYS",
        lambda monday: F.date_add(monday, 6),
    ),
    "M": Period(lambda moment: F.trunc(moment, "month"), "INTERVAL 1 MONTH", F.last_day),
}


def period_label(rule: str, moment: Column) -> Column:
    """Timestamp that labels the bucket holding `moment`."""
    period = PERIODS[rule]
    return period.label(period.anchor(moment)).cast("timestamp")


def month_start(moment: Column) -> Column:
    return F.trunc(moment, "month")


def month_index(month: Column) -> Column:
    """Consecutive integer per calendar month."""
    return (F.year(month) * 12 + F.month(month) - 1).cast("int")


def month_text(month: Column) -> Column:
    return F.date_format(month, MONTH_TEXT)


def step_text(month: Column) -> Column:
    """`previous calendar month → month`."""
    return F.concat(month_text(F.add_months(month, -1)), F.lit(" → "), month_text(month))
