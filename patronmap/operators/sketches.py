"""Distinct customers of any range of days from stored sketches: an option beside the exact counts.

A day keeps revenue, transactions and a mergeable sketch of its customers, of a fixed size
whatever their number. Days are united into weeks, months and ranges without going back to the
transactions. Revenue and transactions stay exact; customers are estimates, with a standard error
of about 1.04 / sqrt(2^precision): 0.8 % for the default. Sketches are combined before they
are shuffled, so a day or customer with a third of all rows costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronmap.functions.numbers import known_number, ratio
from patronmap.functions.periods import PERIODS
from patronmap.operators.trends import fill_periods
from patronmap.schema import AMOUNT, CUSTOMER, DATE, REVENUE, TRANSACTIONS

SKETCH, DAY = "customers_sketch", "day"
PRECISION = 14


def _sketched(df: DataFrame) -> Column:
    """The customer in a type that sketches take; equal customers have equal values."""
    kind = df.schema[CUSTOMER].dataType
    plain = isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType))
    return F.col(CUSTOMER) if plain else F.col(CUSTOMER).cast("string")


def daily_sketches(df: DataFrame, precision: int = PRECISION) -> DataFrame:
    """A row per day: rows, revenue, transactions and the sketch of customers."""
    customer = _sketched(df)
    return df.groupBy(F.to_date(DATE).alias(DAY)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(known_number(df, AMOUNT)).alias(REVENUE),
        F.count(known_number(df, AMOUNT)).alias(TRANSACTIONS),
        F.hll_sketch_agg(customer, F.lit(precision)).alias(SKETCH),
    )


def _united() -> list[Column]:
    estimate = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(SKETCH)), F.lit(0))
    return [
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.sum(REVENUE).alias(REVENUE),
        F.coalesce(F.sum(TRANSACTIONS), F.lit(0)).alias(TRANSACTIONS),
        estimate.alias("customers"),
    ]


def kpi_of_days(daily: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row for the days from `start` to `end`, both whole: customers (estimated), rows, revenue, mean amount."""
    chosen = daily
    if start is not None:
        chosen = chosen.where(F.col(DAY) >= F.lit(start).cast("date"))
    if end is not None:
        chosen = chosen.where(F.col(DAY) <= F.lit(end).cast("date"))
    return chosen.agg(*_united()).select(
        "customers", "rows", F.coalesce(F.col(REVENUE).cast("double"), F.lit(0.0)).alias(REVENUE),
        ratio(F.col(REVENUE), F.col(TRANSACTIONS)).alias("avg_order"),
    )


def trend_of_days(daily: DataFrame, rule: str) -> DataFrame:
    """The columns of `trend` per day, week or month, with estimated customers; empty periods appear."""
    anchor = PERIODS[rule].anchor(F.col(DAY)).alias("_anchor")
    totals = daily.where(F.col(DAY).isNotNull()).groupBy(anchor).agg(*_united())
    return fill_periods(
        totals.select("_anchor", F.col(REVENUE).cast("double").alias(REVENUE), TRANSACTIONS, F.col("customers").alias("active_customers")), rule
    )
