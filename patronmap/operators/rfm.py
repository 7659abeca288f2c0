"""Recency, frequency and monetary value per customer, scores, weights and labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronmap.functions.numbers import known_number
from patronmap.operators.cleaning import drop_missing
from patronmap.operators.ranking import quantile_cuts, rank_metrics, widen_ranks
from patronmap.schema import AMOUNT, CUSTOMER, DATE, FREQUENCY, LABEL, MONETARY, RECENCY
from patronmap.schema import RFM_METRICS
from patronmap.settings import SegmentRules, Weights
from patronmap.storage import store

MICROS_PER_DAY = 86_400_000_000


def recency_days(last: Column, snapshot: str) -> Column:
    """Whole elapsed 24-hour days from a timestamp to `snapshot`, rounded down."""
    elapsed = F.unix_micros(F.lit(snapshot).cast("timestamp")) - F.unix_micros(last)
    day = F.lit(MICROS_PER_DAY)
    return F.call_function("div", elapsed - F.pmod(elapsed, day), day)


def compute_rfm(df: DataFrame, snapshot: str) -> DataFrame:
    """One row per customer; one shuffle of pre-aggregated rows.

    Recency is the number of whole elapsed 24-hour days from the last transaction to
    `snapshot`, rounded down (-1 for an hour after it). Frequency counts dated rows.
    """
    last = F.max(F.col(DATE).cast("timestamp"))
    return (
        drop_missing(df, CUSTOMER)
        .groupBy(CUSTOMER)
        .agg(
            last.alias("_last"),
            F.count(DATE).alias(FREQUENCY),
            F.coalesce(F.sum(known_number(df, AMOUNT)).cast("double"), F.lit(0.0)).alias(MONETARY),
        )
        .select(CUSTOMER, recency_days(F.col("_last"), snapshot).alias(RECENCY), FREQUENCY, MONETARY)
    )


def rfm_ranks(rfm: DataFrame) -> DataFrame:
    """Rank of every customer in each metric, ties in order of customer id."""
    return widen_ranks(rank_metrics(rfm, RFM_METRICS, CUSTOMER), RFM_METRICS, CUSTOMER)


def score_rfm(rfm: DataFrame, stored: bool = False) -> DataFrame:
    """Quintile scores 1..5 per metric; 5 is the most recent, frequent, valuable fifth.

    Needs two passes over `rfm`, which is therefore written once unless it is `stored`.
    """
    if not stored:
        rfm = store(rfm, "rfm")
    key_type = rfm.schema[CUSTOMER].dataType
    recency, frequency, monetary = (
        cuts.bin(CUSTOMER, key_type) for cuts in quantile_cuts(rfm, RFM_METRICS, CUSTOMER)
    )
    scored = rfm.withColumns({"R_score": 6 - recency, "F_score": frequency, "M_score": monetary})
    r, f, m = F.col("R_score"), F.col("F_score"), F.col("M_score")
    return scored.withColumns(
        {
            "RFM_score": F.concat(*(c.cast("string") for c in (r, f, m))),
            "RFM_sum": r + f + m,
        }
    )


def add_weighted_scores(scored: DataFrame, weights: Weights | Mapping | None) -> DataFrame:
    """Scores times weights, and their sums."""
    w = Weights.of(weights)
    r, f, m = (F.col(f"{name}_weighted") for name in "RFM")
    return (
        scored.withColumns(
            {f"{name}_weighted": F.col(f"{name}_score") * getattr(w, name) for name in "RFM"}
        )
        .withColumn("FM_weighted", f + m)
        .withColumn("RFM_weighted_sum", r + f + m)
    )


def label_segments(
    weighted: DataFrame,
    weights: Weights | Mapping | None,
    rules: SegmentRules | Mapping | None = None,
) -> DataFrame:
    """Name the segment of each customer; the first rule that holds wins.

    A customer without scores has no segment.
    Limits are computed in Python and compared as doubles: a weighted score that should
    sit exactly on a limit may miss it by one rounding, and must do so the same way here.
    """
    w, share = Weights.of(weights), SegmentRules.of(rules)
    top_r, top_fm = 5.0 * w.R, 5.0 * w.F + 5.0 * w.M
    r, fm = F.col("R_weighted"), F.col("FM_weighted")

    def r_min(part: float) -> Column:
        return r >= part * top_r

    def r_max(part: float) -> Column:
        return r <= part * top_r

    def fm_min(part: float) -> Column:
        return fm >= part * top_fm

    def fm_max(part: float) -> Column:
        return fm <= part * top_fm

    # Segment names and the order in which they are tried.
    label = (
        F.when(r_min(share.vip_r_min) & fm_min(share.vip_fm_min), "VIP / Champions")
        .when(r_min(share.loyal_r_min) & fm_min(share.loyal_fm_min), "Loyal / Active")
        .when(r_min(share.potential_r_min) & fm_min(share.potential_fm_min), "Potential Loyalists")
        .when(r_max(share.risk_r_max) & fm_min(share.risk_fm_min), "At Risk")
        .when(r_max(share.lost_r_max) & fm_max(share.lost_fm_max), "Lost")
        .when(r_min(share.new_r_min) & fm_max(share.new_fm_max), "New")
        .when(r.isNotNull() & fm.isNotNull(), "Regular")
    )
    return weighted.withColumn(LABEL, label)
