"""KPIs, calendar trends and comparisons of segments.

Every operator takes transactions (`amount`) or an activity table (`revenue`,
`transactions` per customer and period). Rows are first reduced to one per customer and
group, so distinct customers are plain counts and no customer makes a hot partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronmap.functions.numbers import half_even, known_number, ratio
from patronmap.functions.periods import PERIODS, period_label
from patronmap.schema import AMOUNT, CUSTOMER, DATE, LABEL, REVENUE, TRANSACTIONS


def _is_activity(df: DataFrame) -> bool:
    return AMOUNT not in df.columns


def revenue_of(df: DataFrame) -> Column:
    return F.sum(known_number(df, REVENUE if _is_activity(df) else AMOUNT))


def transactions_of(df: DataFrame) -> Column:
    return F.sum(TRANSACTIONS) if _is_activity(df) else F.count(known_number(df, AMOUNT))


def activity(df: DataFrame, rule: str | None = "D") -> DataFrame:
    """Revenue and transactions per customer and day, week or month, or in all.

    Small compared with the transactions, and the better side to join segments to. The
    date is the first day of the period; daily activity serves every other period.
    """
    keys = [CUSTOMER]
    if rule is not None:
        keys.append(PERIODS[rule].anchor(F.col(DATE)).cast("timestamp").alias(DATE))
    return df.groupBy(*keys).agg(
        revenue_of(df).alias(REVENUE), transactions_of(df).alias(TRANSACTIONS)
    )


def _per_customer(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys, CUSTOMER).agg(
        revenue_of(df).alias(REVENUE), transactions_of(df).alias(TRANSACTIONS)
    )


def kpi(df: DataFrame) -> DataFrame:
    """One row: customers, rows, revenue and mean amount."""
    rows = F.sum(TRANSACTIONS) if _is_activity(df) else F.count(F.lit(1))
    per_customer = df.groupBy(CUSTOMER).agg(
        rows.alias("rows"), revenue_of(df).alias(REVENUE), transactions_of(df).alias(TRANSACTIONS)
    )
    revenue = F.coalesce(F.sum(REVENUE).cast("double"), F.lit(0.0))
    return per_customer.agg(
        F.count(CUSTOMER).alias("customers"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        revenue.alias(REVENUE),
        ratio(F.sum(REVENUE), F.sum(TRANSACTIONS)).alias("avg_order"),
    )


def trend(df: DataFrame, rule: str) -> DataFrame:
    """Revenue, transactions, customers and mean order per day, week or month.

    Periods without rows appear with zeros. They are generated from the gap to the next
    period with rows, so the input is read once; the window that looks ahead runs over
    one row per calendar period.
    """
    period = PERIODS[rule]
    totals = (
        _per_customer(df, period.anchor(F.col(DATE)).alias("_anchor"))
        .groupBy("_anchor")
        .agg(
            F.sum(REVENUE).cast("double").alias(REVENUE),
            F.sum(TRANSACTIONS).alias(TRANSACTIONS),
            F.count(CUSTOMER).alias("active_customers"),
        )
    )
    return fill_periods(totals, rule)


def fill_periods(totals: DataFrame, rule: str) -> DataFrame:
    """Totals per first day of a period (`_anchor`) as a trend, in which empty periods appear."""
    period = PERIODS[rule]
    following = F.lead("_anchor").over(Window.orderBy("_anchor"))
    step = F.expr(period.step)
    upto = F.coalesce((F.col("_next") - step).cast("date"), F.col("_anchor"))
    filled = totals.withColumn("_next", following).withColumn(
        "_period", F.explode(F.sequence(F.col("_anchor"), upto, step))
    )
    seen = F.col("_period") == F.col("_anchor")
    return filled.select(
        period.label(F.col("_period")).cast("timestamp").alias(DATE),
        F.when(seen, F.col(REVENUE)).otherwise(0.0).alias(REVENUE),
        F.when(seen, F.col(TRANSACTIONS)).otherwise(0).alias(TRANSACTIONS),
        F.when(seen, F.col("active_customers")).otherwise(0).alias("active_customers"),
        F.when(seen, ratio(F.col(REVENUE), F.col(TRANSACTIONS))).alias("avg_order_value"),
    )


def segment_trend(df: DataFrame, rule: str, segment: str = LABEL) -> DataFrame:
    """Revenue per period and segment, for the pairs that occur."""
    return (
        df.where(F.col(segment).isNotNull())
        .groupBy(period_label(rule, F.col(DATE)).alias(DATE), segment)
        .agg(revenue_of(df).cast("double").alias(REVENUE))
    )


def segment_totals(df: DataFrame, segment: str = LABEL) -> DataFrame:
    """Customers, transactions and revenue per segment: base of the two tables below."""
    return (
        _per_customer(df.where(F.col(segment).isNotNull()), segment)
        .groupBy(segment)
        .agg(
            F.count(CUSTOMER).alias("customers"),
            F.sum(TRANSACTIONS).alias(TRANSACTIONS),
            F.sum(REVENUE).alias(REVENUE),
        )
    )


def segment_share(totals: DataFrame, segment: str = LABEL) -> DataFrame:
    """Share of every segment in the revenue of all segments, in percent."""
    revenue = F.col(REVENUE).cast("double")
    everything = F.sum(REVENUE).over(Window.partitionBy()).cast("double")
    return totals.select(
        F.col(segment).alias("segment"),
        "customers",
        revenue.alias(REVENUE),
        ratio(F.col(REVENUE), F.col(TRANSACTIONS)).alias("avg_order"),
        half_even(ratio(revenue, everything) * 100.0).alias("share_pct"),
    )


def segment_comparison(totals: DataFrame, segment: str = LABEL) -> DataFrame:
    """Segments by revenue, highest first."""
    return totals.select(
        F.col(segment).alias("segment"),
        "customers",
        TRANSACTIONS,
        F.col(REVENUE).cast("double").alias(REVENUE),
        ratio(F.col(REVENUE), F.col(TRANSACTIONS)).alias("avg_order"),
    ).orderBy(F.desc(REVENUE), "segment")
