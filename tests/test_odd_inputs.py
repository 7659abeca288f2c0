"""Inputs that the given tables do not hold: odd dates, white space, line breaks, wide products."""

from __future__ import annotations

import datetime as dt
import math

import pytest

from patronmap.operators import rfm, segments, trends
from patronmap.operators.cleaning import coerce
from patronmap.operators.ranking import quantile_cuts
from patronmap.settings import Settings
from patronmap.sources import delimited, mapping, results
from patronmap.storage import fresh_path, scratch, store

RAW = "customer_id STRING, transaction_date STRING, amount DOUBLE"


def dates(spark, values, kind="STRING"):
    rows = [("a", v, 1.0) for v in values]
    frame = spark.createDataFrame(rows, f"customer_id STRING, transaction_date {kind}, amount DOUBLE")
    return [r.transaction_date for r in coerce(frame).collect()]


def test_dates_as_text(spark):
    found = dates(spark, ["20230110", " 20230110 ", "2023-01-10", "2023-01-10T05:06", "2023", "12345", "202301", "20231340", "1:30", None])
    day = dt.datetime(2023, 1, 10)
    assert found == [day, day, day, dt.datetime(2023, 1, 10, 5, 6), dt.datetime(2023, 1, 1), None, None, None, None, None]


def test_dates_as_numbers_count_nanoseconds(spark):
    assert dates(spark, [1_673_308_800_000_000_000, None], "BIGINT") == [dt.datetime(2023, 1, 10), None]
    assert dates(spark, [1.5e9, math.nan], "DOUBLE") == [dt.datetime(1970, 1, 1, 0, 0, 1, 500000), None]
    assert dates(spark, [True], "BOOLEAN") == [None]


def test_white_space_survives_the_export(spark):
    path = fresh_path(spark, "spaces")
    frame = spark.createDataFrame([(" a ",), ("b\t",), ("",), (None,)], "customer_id STRING").coalesce(1)
    delimited.write_delimited(frame.selectExpr("customer_id", "1 AS one"), path)
    found = [r.customer_id for r in delimited.scan_delimited(spark, path, ",").collect()]
    assert found[:2] == [" a ", "b\t"]


def test_line_breaks_need_multi_line(spark):
    frame = spark.createDataFrame([("a\nb", 1), ("c", 2)], "customer_id STRING, n INT").coalesce(1)
    with pytest.raises(Exception, match="line break"):
        delimited.write_delimited(frame, fresh_path(spark, "refused"))
    path = fresh_path(spark, "breaks")
    delimited.write_delimited(frame, path, multi_line=True)
    found = delimited.scan_delimited(spark, path, ",", multi_line=True).collect()
    assert sorted(r.customer_id for r in found) == ["a\nb", "c"]


def test_wide_products(spark):
    frame = spark.createDataFrame([("a", "2023-01-01", 100_000, 100_000)], "c STRING, d STRING, q INT, p INT")
    names = mapping.ColumnMapping("c", "d", qty_col="q", price_col="p")
    assert mapping.map_columns(frame, names).first().amount == 10_000_000_000
    wide = frame.selectExpr("c", "d", "9223372036854775807 AS q", "2 AS p")
    assert mapping.map_columns(wide, names).first().amount is None


def test_nan_amounts_are_skipped(spark):
    rows = [("a", "2023-01-10", 10.0), ("a", "2023-01-11", math.nan), ("b", "2023-01-12", None)]
    frame = coerce(spark.createDataFrame(rows, RAW))
    row = trends.kpi(frame).first()
    assert (row.customers, row.rows, row.revenue, row.avg_order) == (2, 3, 10.0, 10.0)
    metrics = {r.customer_id: r.monetary for r in rfm.compute_rfm(frame, "2023-02-01").collect()}
    assert metrics == {"a": 10.0, "b": 0.0}
    assert trends.segment_totals(frame.selectExpr("*", "'x' AS Segment_label")).first().revenue == 10.0


def test_known_labels_come_before_missing_ones(spark):
    rows = [(1, None, None), (1, 2, "VIP"), (2, None, None), (3, 5, None), (3, 4, None)]
    frame = spark.createDataFrame(rows, "customer_id INT, cluster INT, Segment_label STRING")
    found = {r.customer_id: (r["cluster"], r.Segment_label) for r in segments.dedup_segments(frame).collect()}
    assert found == {1: (2, "VIP"), 2: (None, None), 3: (4, None)}


def test_customers_without_scores_have_no_label(spark):
    frame = spark.createDataFrame([(1, 5, 5, 5), (2, None, 5, 5)], "customer_id INT, R_score INT, F_score INT, M_score INT")
    labelled = rfm.label_segments(rfm.add_weighted_scores(frame, None), None)
    assert {r.customer_id: r.Segment_label for r in labelled.collect()} == {1: "VIP / Champions", 2: None}


def test_unknown_settings_are_ignored():
    given = {"segment_rules": {"x": 1, "vip_r_min": 0.5}, "auto_k": {"k_min": 3, "y": 2}, "rfm_weights": {"Z": 1}, "w": 1}
    settings = Settings.from_dict(given)
    assert settings.segment_rules.vip_r_min == 0.5 and settings.auto_k.k_min == 3
    assert Settings.from_dict(settings.to_dict()) == settings


def test_results_are_stored_by_dataset(spark):
    folder = fresh_path(spark, "results")
    frame = spark.createDataFrame([(1, 2)], "customer_id INT, recency INT")
    assert results.stored_result(spark, folder, "d1", "rfm") is None
    for _ in range(2):
        results.store_result(frame, folder, "d1", "rfm")
    assert results.stored_result(spark, folder, "d1", "rfm").count() == 1
    made = results.export_available(spark, {"rfm": frame, "empty": frame.limit(0), "none": None}, f"{folder}/out").collect()
    assert [tuple(r) for r in made] == [("rfm", 1)]
    assert results.read_result(spark, f"{folder}/out/empty") is None


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 50])
def test_quantile_ends_of_small_tables(spark, n):
    frame = spark.createDataFrame([(i, float(i % 3)) for i in range(n)], "customer_id INT, v DOUBLE")
    (cuts,) = quantile_cuts(frame, ["v"], "customer_id")
    rows = frame.select("customer_id", "v", cuts.bin("customer_id", frame.schema["customer_id"].dataType).alias("bin")).collect()
    for rank, row in enumerate(sorted(rows, key=lambda r: (r.v, r.customer_id)), 1):
        assert row.bin == (max(1, -(-(rank - 1) * 5 // (n - 1))) if n > 1 else 1)


def test_scopes_delete_on_failure_and_keep_results(spark):
    frame = spark.range(3)
    with scratch(spark) as outer:
        inner = store(frame, "a")
        with pytest.raises(ValueError), scratch(spark):
            lost = store(frame, "b")
            raise ValueError
        with scratch(spark) as scope:
            kept = scope.keep(inner)
        assert kept.count() == 3 and len(outer.paths) == 2
        with pytest.raises(Exception):
            lost.count()
    with pytest.raises(Exception):
        kept.count()
