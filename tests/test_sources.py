from __future__ import annotations

import datetime as dt

import pytest

from patronmap.plans.report import build_report
from patronmap.settings import AutoK, Settings, Weights
from patronmap.sources import delimited as d
from patronmap.sources import mapping as m
from patronmap.sources import results as r
from patronmap.storage import fresh_path

NAMES = m.ColumnMapping("Customer ID", "Date", qty_col="Quantity", price_col="Price")


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separator_is_found(spark, tmp_path, sep):
    file = tmp_path / "sales.csv"
    quoted = f'"a{sep}b,c;d|e"'
    lines = [["Customer ID", "Date", "Quantity", "Price"], [quoted, "2023-01-01", "2", "1.5"],
             ["x", "2023-01-02 10:00:00", "3", "oops"]]
    file.write_text("\n".join(sep.join(line) for line in lines) + "\n\n")
    assert d.detect_separator(spark, str(file)) == sep
    read = d.read_transactions(spark, str(file), NAMES).collect()
    assert [tuple(row) for row in read] == [
        (f"a{sep}b,c;d|e", dt.datetime(2023, 1, 1), 3.0),
        ("x", dt.datetime(2023, 1, 2, 10), None),
    ]


def test_more_fields_win_a_tie(spark, tmp_path):
    file = tmp_path / "sales.csv"
    file.write_text("a;b;c,d\n1;2;3,4\n")
    assert d.detect_separator(spark, str(file)) == ";"


def test_most_lines_decide(spark, tmp_path):
    file = tmp_path / "sales.csv"
    file.write_text("a,b\n1,2\n3,4\nx;y;z,1,2\n")
    assert d.detect_separator(spark, str(file)) == ","


def test_no_separator(spark, tmp_path):
    file = tmp_path / "sales.csv"
    file.write_text("a\nb\n")
    with pytest.raises(ValueError):
        d.detect_separator(spark, str(file))


def test_amount_column_or_product():
    with pytest.raises(ValueError):
        m.ColumnMapping("a", "b")
    with pytest.raises(ValueError):
        m.ColumnMapping("a", "b", qty_col="q")
    with pytest.raises(ValueError):
        m.ColumnMapping("a", "b", amount_col="x", qty_col="q", price_col="p")
    assert NAMES.amount_mode == m.QUANTITY_TIMES_PRICE


def test_only_mapped_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.sql("SELECT 1 AS `a.b`, 'x' AS other, DATE '2023-01-01' AS day, 2.5D AS total") \
        .write.parquet(path)
    mapped = m.map_columns(spark.read.parquet(path), m.ColumnMapping("a.b", "day", "total"))
    assert [tuple(row) for row in mapped.collect()] == [(1, dt.date(2023, 1, 1), 2.5)]
    plan = mapped._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a.b:int,day:date,total:double>" in plan


def test_missing_result_is_none_and_damage_is_an_error(spark, tmp_path):
    assert r.read_result(spark, str(tmp_path / "absent")) is None
    (tmp_path / "broken.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        r.read_result(spark, str(tmp_path / "broken.parquet"))


def test_export_round_trip(spark, tmp_path):
    rows = [("a,\"b\"", dt.datetime(2023, 1, 1, 10, 0, 0, 250000), 1.1), (None, None, None)]
    frame = spark.createDataFrame(rows, "customer_id STRING, transaction_date TIMESTAMP, amount DOUBLE")
    path = str(tmp_path / "out")
    d.write_delimited(frame, path)
    back = d.scan_delimited(spark, path, ",").collect()
    assert {tuple(row) for row in back} == {
        ('a,"b"', "2023-01-01 10:00:00.250000", "1.1"), (None, None, None)
    }


def test_export_lists_what_exists(spark, tmp_path):
    rows = [(1, "2023-01-01", 2.0), (2, "bad", 3.0)]
    raw = spark.createDataFrame(rows, "customer_id BIGINT, transaction_date STRING, amount DOUBLE")
    rfm = spark.range(3).toDF("customer_id")
    made = build_report(spark, raw, rfm=rfm, clusters_path=str(tmp_path / "absent"))
    listed = made.export(spark, str(tmp_path / "all"))
    assert {tuple(row) for row in listed.collect()} == {("transactions", 1), ("rfm", 3)}
    assert (tmp_path / "all" / "rfm").is_dir() and not (tmp_path / "all" / "clusters").exists()
    empty = r.export_available(spark, {"rfm": rfm.limit(0)}, str(tmp_path / "none"))
    assert empty.count() == 0


def test_report_prefers_given_over_stored(spark, tmp_path):
    raw = spark.createDataFrame(
        [(1, "2023-01-01", 2.0)], "customer_id BIGINT, transaction_date STRING, amount DOUBLE"
    )
    stored = str(tmp_path / "rfm")
    spark.range(3).toDF("customer_id").write.parquet(stored)
    assert build_report(spark, raw, rfm_path=stored).summary.first().rfm_available is True
    given = spark.range(0).toDF("customer_id")
    made = build_report(spark, raw, rfm=given, rfm_path=stored)
    assert made.summary.first().rfm_available is False


def test_catalog(spark, tx):
    catalog = fresh_path(spark, "catalog")
    assert r.read_catalog(spark, catalog) is None
    frame = tx([(1, "2023-01-01", 2.0), (1, "2023-02-01", 3.0), (2, "2023-01-15", 1.0)])
    r.register_dataset(frame, "one", "first.csv", NAMES, catalog)
    r.register_dataset(frame.limit(0), "two", "second.csv", NAMES, catalog)
    two, one = r.read_catalog(spark, catalog).collect()
    assert (two.id, two.rows, two.customers, two.min_date) == ("two", 0, 0, None)
    assert (one.rows, one.customers) == (3, 2)
    assert (one.min_date, one.max_date) == (dt.datetime(2023, 1, 1), dt.datetime(2023, 2, 1))
    assert one.mapping.qty_col == "Quantity" and one.mapping.amount_col is None


def test_settings_are_merged():
    assert Settings.from_dict() == Settings()
    given = {
        "rfm_weights": {"R": 1.3},
        "auto_k": {"k_min": 9, "k_max": 3},
        "segmentation_default_algorithm": "Hierarchical (Agglomerative)",
        "segment_rules": {"vip_r_min": 0.9},
    }
    merged = Settings.from_dict(given)
    assert merged.rfm_weights == Weights(R=1.3, F=1.0, M=1.0)
    assert merged.auto_k == AutoK(3, 9) and list(AutoK(3, 5).values()) == [3, 4, 5]
    assert merged.segmentation_default_algorithm == "Hierarchical"
    assert merged.segment_rules.vip_r_min == 0.9 and merged.segment_rules.vip_fm_min == 0.8
    assert merged.default_scaler == "StandardScaler"
    assert Settings.from_dict(merged.to_dict()) == merged
