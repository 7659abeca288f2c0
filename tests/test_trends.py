from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import as_dict
from patronmap.operators import growth as g
from patronmap.operators import report as rp
from patronmap.operators import segments as s
from patronmap.operators import trends as t
from patronmap.plans.monitoring import monitor

ROWS = [
    (1, "2023-01-01 15:00:00", 1.0, "a"),
    (2, "2023-01-02 00:00:00", 2.0, "b"),
    (3, "2023-01-20 09:00:00", 3.0, None),
    (1, "2023-03-05 00:00:00", 4.0, "a"),
]
SCHEMA = "customer_id BIGINT, transaction_date STRING, amount DOUBLE, Segment_label STRING"


@pytest.fixture
def sales(tx):
    return tx(ROWS, SCHEMA)


@pytest.mark.parametrize("daily", [False, True])
def test_days_weeks_and_months(sales, daily):
    base = t.activity(sales) if daily else sales
    days = as_dict(t.trend(base, "D"), "transaction_date")
    assert len(days) == 64
    assert tuple(days[dt.datetime(2023, 1, 3)])[1:] == (0.0, 0, 0, None)
    weeks = as_dict(t.trend(base, "W"), "transaction_date")
    assert len(weeks) == 10 and all(day.weekday() == 6 for day in weeks)
    assert weeks[dt.datetime(2023, 1, 1)].revenue == 1.0
    assert weeks[dt.datetime(2023, 1, 8)].revenue == 2.0
    assert weeks[dt.datetime(2023, 3, 5)].revenue == 4.0
    months = as_dict(t.trend(base, "M"), "transaction_date")
    assert sorted(months) == [
        dt.datetime(2023, 1, 31), dt.datetime(2023, 2, 28), dt.datetime(2023, 3, 31)
    ]
    january = months[dt.datetime(2023, 1, 31)]
    assert tuple(january)[1:] == (6.0, 3, 3, 2.0)


def test_activity_of_longer_periods(sales):
    assert t.activity(sales, None).columns == ["customer_id", "revenue", "transactions"]
    for rule in "WM":
        direct = sorted(map(tuple, t.trend(sales, rule).collect()))
        assert sorted(map(tuple, t.trend(t.activity(sales, rule), rule).collect())) == direct


def test_trend_of_nothing(sales):
    assert t.trend(sales.limit(0), "D").count() == 0


def test_trend_adds_up_to_kpi(sales):
    total = t.trend(sales, "W").agg(F.sum("revenue")).first()[0]
    one = t.kpi(sales).first()
    assert (one.customers, one.rows, one.revenue, one.avg_order) == (3, 4, 10.0, 2.5)
    assert total == one.revenue


def test_kpi_of_raw_rows(spark):
    raw = spark.createDataFrame(
        [(1, 2.0), (1, None), (None, 4.0)], "customer_id BIGINT, amount DOUBLE"
    )
    assert tuple(t.kpi(raw).first()) == (1, 3, 6.0, 3.0)
    assert tuple(t.kpi(raw.limit(0)).first()) == (0, 0, 0.0, None)


def test_segment_trend_has_observed_pairs_only(sales):
    weeks = as_dict(t.segment_trend(sales, "W"), "transaction_date", "Segment_label")
    assert {k: r.revenue for k, r in weeks.items()} == {
        (dt.datetime(2023, 1, 1), "a"): 1.0,
        (dt.datetime(2023, 1, 8), "b"): 2.0,
        (dt.datetime(2023, 3, 5), "a"): 4.0,
    }


def test_share_and_comparison(sales):
    totals = t.segment_totals(sales)
    share = as_dict(t.segment_share(totals), "segment")
    assert tuple(share["a"]) == ("a", 1, 5.0, 2.5, 71.43)
    assert tuple(share["b"]) == ("b", 1, 2.0, 2.0, 28.57)
    compared = [tuple(r) for r in t.segment_comparison(totals).collect()]
    assert compared == [("a", 1, 2, 5.0, 2.5), ("b", 1, 1, 2.0, 2.0)]


def test_share_rounds_half_to_even(tx):
    rows = [(1, "2023-01-01", 1.0, "a"), (2, "2023-01-01", 799.0, "b")]
    share = as_dict(t.segment_share(t.segment_totals(tx(rows, SCHEMA))), "segment")
    assert share["a"].share_pct == 0.12


def test_segments_are_attached_once(spark, sales):
    known = spark.createDataFrame(
        [(1, 2, "x"), (1, 1, "x"), (2, 5, None), (9, 9, "z")],
        "customer_id BIGINT, cluster INT, Segment_label STRING",
    )
    joined = s.attach_segments(sales.drop("Segment_label"), known)
    found = {(r.customer_id, r.cluster, r.Segment_label) for r in joined.collect()}
    assert joined.count() == 4
    assert found == {(1, 1, "x"), (2, 5, None), (3, None, None)}


def test_segment_columns_are_optional(spark, sales):
    only_cluster = spark.createDataFrame([(1, 2)], "customer_id BIGINT, cluster INT")
    assert s.dedup_segments(only_cluster).columns == ["customer_id", "cluster"]
    plain = s.attach_segments(sales.drop("Segment_label"), None)
    assert plain.select("cluster", "Segment_label").distinct().collect() == [("—", "—")]


def test_distinct_and_chosen_segment(sales):
    assert sorted(r[0] for r in s.distinct_segments(sales).collect()) == ["a", "b"]
    assert s.customers_of_segment(sales, "a").count() == 2


def test_recommendations_keep_unknown_segments(spark, sales):
    texts = spark.createDataFrame([("a", "call")], "Segment_label STRING, text STRING")
    joined = s.recommend(sales, texts)
    assert sorted((r.Segment_label or "", r.text or "") for r in joined.collect()) == [
        ("", ""), ("a", "call"), ("a", "call"), ("b", "")
    ]


def test_large_texts_are_not_broadcast(spark, sales, monkeypatch):
    texts = spark.createDataFrame([("a", "call")], "Segment_label STRING, text STRING")
    hinted = "ResolvedHint (strategy=broadcast)"
    assert hinted in s.broadcast_if_small(texts)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(s, "BROADCAST_ROWS", 0)
    assert hinted not in s.broadcast_if_small(texts)._jdf.queryExecution().analyzed().toString()


def test_hot_customer_is_split(spark):
    """A customer with a third of the rows is read by several tasks in the join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000)
        rows = spark.range(0, 200_000, 1, 16).select(
            key.alias("customer_id"), F.rand(1).alias("amount")
        )
        known = spark.range(1000).select(
            F.col("id").alias("customer_id"), F.lit("x").alias("Segment_label")
        )
        joined = s.attach_segments(rows, known)
        assert len(joined.collect()) == 200_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


MONTHS = ["2023-01-05", "2023-02-05", "2023-03-05", "2023-04-05", "2023-05-05"]
X = [100.0, None, 150.0, 0.0, 5.0]
Y = [None, 10.0, 20.0, None, None]


@pytest.fixture
def matrix(tx):
    rows = [
        (1, day, value, name)
        for name, values in (("x", X), ("y", Y))
        for day, value in zip(MONTHS, values)
        if value is not None
    ]
    return g.month_segment_matrix(tx(rows, SCHEMA))


def changes(df, segment):
    rows = sorted((r for r in df.collect() if r.segment == segment), key=lambda r: r.month)
    return [r.change for r in rows]


def test_matrix_has_every_pair(matrix):
    cells = as_dict(matrix, "segment", "month")
    assert len(cells) == 10
    assert cells["y", dt.date(2023, 1, 1)].revenue is None
    assert cells["x", dt.date(2023, 1, 1)].month_index == 2023 * 12


def test_months_without_any_rows_are_absent(tx):
    rows = [(1, "2023-01-05", 1.0, "x"), (1, "2023-03-05", 3.0, "x")]
    grown = g.segment_growth(g.month_segment_matrix(tx(rows, SCHEMA)))
    assert changes(grown, "x") == [None, 2.0]
    event = g.growth_events(grown).first()
    assert (event.best_growth_pct, event.best_step) == (200.0, "2023-02 → 2023-03")


def test_padded_growth(matrix):
    grown = g.segment_growth(matrix)
    assert changes(grown, "x") == [None, 0.0, 0.5, -1.0, math.inf]
    assert changes(grown, "y") == [None, None, 1.0, 0.0, 0.0]
    rates = [(r.segment, r.mean_growth) for r in g.growth_rate(grown).collect()]
    assert rates == [("x", math.inf), ("y", pytest.approx(1 / 3))]
    directions = as_dict(g.growth_direction(grown), "segment")
    assert directions["y"].direction == "growing"


def test_growth_without_fill(matrix):
    grown = g.segment_growth(matrix, fill="none")
    assert changes(grown, "x") == [None, None, None, -1.0, math.inf]
    assert changes(grown, "y") == [None, None, 1.0, None, None]


def test_zero_against_zero_is_no_change(tx):
    rows = [(1, day, value, "x") for day, value in zip(MONTHS, [0.0, 0.0, -5.0])]
    grown = g.segment_growth(g.month_segment_matrix(tx(rows, SCHEMA)))
    assert changes(grown, "x") == [None, None, -math.inf]


def test_events_and_extremes(matrix):
    events = g.growth_events(g.segment_growth(matrix))
    found = as_dict(events, "segment")
    assert tuple(found["y"]) == ("y", 100.0, "2023-02 → 2023-03", 0.0, "2023-03 → 2023-04")
    assert found["x"].worst_growth_pct == -100.0
    extremes = as_dict(g.growth_extremes(events), "kind")
    assert (extremes["best"].segment, extremes["best"].change_pct) == ("x", math.inf)
    assert (extremes["worst"].segment, extremes["worst"].change_pct) == ("x", -100.0)


def test_segment_without_changes(tx):
    rows = [(1, "2023-01-05", 1.0, "x"), (1, "2023-01-05", 1.0, "y"), (1, "2023-02-05", 2.0, "y")]
    rows += [(1, "2023-02-05", 1.0, "z")]
    grown = g.segment_growth(g.month_segment_matrix(tx(rows, SCHEMA)), "none")
    assert [r.segment for r in g.growth_rate(grown).collect()] == ["y", "x", "z"]
    assert [r.segment for r in g.growth_events(grown).collect()] == ["y"]


def test_no_events_no_extremes(tx):
    grown = g.segment_growth(g.month_segment_matrix(tx([(1, "2023-01-05", 1.0, "x")], SCHEMA)))
    assert g.growth_extremes(g.growth_events(grown)).count() == 0


def test_report(sales):
    rfm = sales.select("customer_id")
    row = rp.report_summary(sales, rfm, rfm.limit(0)).first()
    assert tuple(row) == (4, 3, 10.0, 2.5, True, False)
    assert tuple(rp.report_insights(sales).first()) == (1.3, False)
    assert tuple(rp.report_insights(sales.limit(0)).first()) == (None, False)


def test_vip_potential(tx):
    rows = [(1, "2023-01-01", 1.0)] * 3
    assert rp.report_insights(tx(rows)).first().vip_potential is True


def test_monitoring_from_one_pass(spark, tx):
    known = spark.createDataFrame(
        [(1, 0, "a"), (2, 1, "b")], "customer_id BIGINT, cluster INT, Segment_label STRING"
    )
    plain = tx([r[:3] for r in ROWS])
    made = monitor(plain, known, "2023-01-01", "2023-03-05", "M")
    assert made.kpi.first().revenue == 10.0
    assert made.trend.count() == 3
    assert {r.segment: r.share_pct for r in made.segment_share.collect()} == {
        "a": 71.43, "b": 28.57
    }
    assert [r.segment for r in made.segment_comparison.collect()] == ["a", "b"]
    assert made.segment_trend.count() == 3
    # b has no rows in March: its January revenue is carried over.
    assert {r.segment: r.mean_growth for r in made.growth_rate.collect()} == {"a": 3.0, "b": 0.0}
    assert {r.segment: r.direction for r in made.growth_direction.collect()} == {
        "a": "growing", "b": "flat"
    }
    assert made.growth_events.count() == 2
    assert {r.kind: r.segment for r in made.growth_extremes.collect()} == {
        "best": "a", "worst": "b"
    }


def test_results_do_not_depend_on_partitions(sales):
    one = sorted(map(tuple, t.trend(sales.repartition(1), "W").collect()))
    many = sorted(map(tuple, t.trend(sales.repartition(7), "W").collect()))
    assert one == many
