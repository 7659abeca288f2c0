"""All trend and segment tables of one time range, from one pass over the transactions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from patronmap.operators import growth as g
from patronmap.operators import trends as t
from patronmap.operators.cleaning import clean_light, date_range
from patronmap.operators.segments import attach_segments
from patronmap.schema import LABEL
from patronmap.storage import store


@dataclass(frozen=True)
class Monitoring:
    kpi: DataFrame
    trend: DataFrame
    segment_trend: DataFrame
    segment_share: DataFrame
    segment_comparison: DataFrame
    growth_rate: DataFrame
    growth_direction: DataFrame
    growth_events: DataFrame
    growth_extremes: DataFrame


def monitor(
    transactions: DataFrame,
    segments: DataFrame | None,
    start: str,
    end: str,
    rule: str = "D",
    segment: str = LABEL,
    end_of_day: bool = False,
    fill: str = "pad",
) -> Monitoring:
    """Reduce to one row per customer and day, join segments to that, derive every table."""
    chosen = date_range(clean_light(transactions), start, end, end_of_day)
    activity = store(attach_segments(t.activity(chosen), segments), "activity")
    totals = t.segment_totals(activity, segment)
    matrix = store(g.month_segment_matrix(activity, segment), "matrix")
    changes = g.segment_growth(matrix, fill)
    events = g.growth_events(changes)
    return Monitoring(
        kpi=t.kpi(activity),
        trend=t.trend(activity, rule),
        segment_trend=t.segment_trend(activity, rule, segment),
        segment_share=t.segment_share(totals, segment),
        segment_comparison=t.segment_comparison(totals, segment),
        growth_rate=g.growth_rate(changes),
        growth_direction=g.growth_direction(changes),
        growth_events=events,
        growth_extremes=g.growth_extremes(events),
    )
