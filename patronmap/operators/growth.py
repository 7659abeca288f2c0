"""Month-over-month growth of segments.

All steps after the first aggregation work on one row per month and segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronmap.functions.numbers import half_even, number_or_null
from patronmap.functions.periods import month_index, month_start, month_text, step_text
from patronmap.operators.trends import revenue_of
from patronmap.schema import DATE, LABEL, REVENUE
from patronmap.storage import store


def month_segment_revenue(df: DataFrame, segment: str = LABEL) -> DataFrame:
    """Revenue per month and segment, for the pairs that occur."""
    return (
        df.where(F.col(segment).isNotNull())
        .groupBy(month_start(F.col(DATE)).alias("month"), F.col(segment).alias("segment"))
        .agg(revenue_of(df).cast("double").alias(REVENUE))
    )


def month_segment_matrix(df: DataFrame, segment: str = LABEL) -> DataFrame:
    """Every month seen in any segment times every segment, in long form.

    Pairs without rows have null revenue; months seen in no segment are absent. The sums
    are written once; months and segments are distinct values of that small table.
    """
    sums = store(month_segment_revenue(df, segment), "sums")
    # One row with an array of months, joined to each segment: segments x months rows.
    months = sums.select("month").distinct().agg(F.collect_list("month").alias("_months"))
    grid = sums.select("segment").distinct().join(F.broadcast(months))
    grid = grid.select("segment", F.explode("_months").alias("month"))
    return grid.join(sums, ["segment", "month"], "left").select(
        "month", month_index(F.col("month")).alias("month_index"), "segment", REVENUE
    )


def month_segment_wide(
    df: DataFrame, values: list | None = None, segment: str = LABEL
) -> DataFrame:
    """The matrix with one column per segment in `values`, or per segment there is."""
    return (
        df.where(F.col(segment).isNotNull())
        .groupBy(month_start(F.col(DATE)).alias("month"))
        .pivot(segment, values)
        .agg(revenue_of(df).cast("double"))
    )


def _relative_change(current: Column, previous: Column) -> Column:
    """current / previous - 1; against 0 it is infinite, and null for 0 / 0."""
    from_zero = F.when(current > 0, float("inf")).when(current < 0, float("-inf"))
    return F.when(previous == 0, from_zero).otherwise(current / previous - 1.0)


def segment_growth(matrix: DataFrame, fill: str = "pad") -> DataFrame:
    """Change of revenue against the previous month present in the matrix.

    `fill="pad"` carries the last known revenue over months in which a segment has no
    rows, `"none"` leaves their changes null.
    """
    by_month = Window.partitionBy("segment").orderBy("month")
    level = F.col(REVENUE)
    if fill == "pad":
        upto = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        level = F.last(REVENUE, ignorenulls=True).over(upto)
    return (
        matrix.withColumn("_level", level)
        .withColumn("_before", F.lag("_level").over(by_month))
        .withColumn("change", _relative_change(F.col("_level"), F.col("_before")))
        .drop("_level", "_before")
    )


def growth_rate(growth: DataFrame) -> DataFrame:
    """Mean change per segment, highest first; segments without changes come last."""
    return (
        growth.groupBy("segment")
        .agg(number_or_null(F.avg("change")).alias("mean_growth"))
        .orderBy(F.desc_nulls_last("mean_growth"), "segment")
    )


def growth_direction(growth: DataFrame) -> DataFrame:
    """Sign of the mean change; null without one."""
    mean = F.col("mean_growth")
    direction = F.when(mean > 0, "growing").when(mean < 0, "declining").when(mean == 0, "flat")
    return growth_rate(growth).withColumn("direction", direction)


def growth_events(growth: DataFrame) -> DataFrame:
    """Best and worst month of every segment that has changes; the earliest of equals.

    The text names the step from the calendar month before, even where the change is
    measured against an earlier present month.
    """
    latest_last = F.struct("change", -F.col("month_index"), "month")
    latest_first = F.struct("change", "month_index", "month")
    picked = (
        growth.where(F.col("change").isNotNull())
        .groupBy("segment")
        .agg(F.max(latest_last).alias("best"), F.min(latest_first).alias("worst"))
    )
    return picked.select(
        "segment",
        half_even(F.col("best.change") * 100.0).alias("best_growth_pct"),
        step_text(F.col("best.month")).alias("best_step"),
        half_even(F.col("worst.change") * 100.0).alias("worst_growth_pct"),
        step_text(F.col("worst.month")).alias("worst_step"),
    )


def growth_extremes(events: DataFrame) -> DataFrame:
    """The best and the worst event of all segments; the first segment of equals.

    One aggregate picks both, so the events are computed once.
    """
    best = F.struct("best_growth_pct", "best_step")
    worst = F.struct("worst_growth_pct", "worst_step")
    # The lowest (-change, segment) is the highest change in the first segment.
    picked = events.agg(
        F.min(F.struct(-F.col("best_growth_pct"), "segment", best.alias("e"))).alias("best"),
        F.min(F.struct("worst_growth_pct", "segment", worst.alias("e"))).alias("worst"),
    )
    rows = F.array(
        F.struct(
            F.lit("best").alias("kind"),
            F.col("best.segment").alias("segment"),
            F.col("best.e.best_growth_pct").alias("change_pct"),
            F.col("best.e.best_step").alias("step"),
        ),
        F.struct(
            F.lit("worst").alias("kind"),
            F.col("worst.segment").alias("segment"),
            F.col("worst.e.worst_growth_pct").alias("change_pct"),
            F.col("worst.e.worst_step").alias("step"),
        ),
    )
    return picked.where(F.col("best").isNotNull()).select(F.inline(rows))


def month_label(df: DataFrame) -> DataFrame:
    """Show months as `yyyy-MM`."""
    return df.withColumn("month", month_text(F.col("month")))
