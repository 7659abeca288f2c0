"""The one-row report and what it says about customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronmap.functions.numbers import half_even, ratio
from patronmap.operators.trends import kpi
from patronmap.schema import REVENUE


def is_available(df: DataFrame | None) -> bool:
    return df is not None and not df.isEmpty()


def report_summary(
    df: DataFrame, rfm: DataFrame | None = None, clusters: DataFrame | None = None
) -> DataFrame:
    """KPIs of lightly cleaned transactions, and whether results exist."""
    return kpi(df).select(
        "rows",
        "customers",
        REVENUE,
        "avg_order",
        F.lit(is_available(rfm)).alias("rfm_available"),
        F.lit(is_available(clusters)).alias("clusters_available"),
    )


def report_insights(df: DataFrame) -> DataFrame:
    """Orders per customer, and whether customers are worth more than two mean orders."""
    worth = ratio(F.col(REVENUE), F.col("customers"))
    return kpi(df).select(
        half_even(ratio(F.col("rows"), F.col("customers")), 1).alias("orders_per_customer"),
        F.coalesce(worth > F.col("avg_order") * 2.0, F.lit(False)).alias("vip_potential"),
    )
