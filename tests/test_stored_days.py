"""Tables by period, and sketches per day."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from patronmap.operators import cleaning, sketches, trends
from patronmap.sources import dated
from patronmap.storage import fresh_path

ROWS = [(i % 50, f"2023-{1 + i % 12:02d}-{1 + i % 28:02d} {i % 24:02d}:15:00", float(i % 9)) for i in range(600)]


@pytest.fixture
def orders(tx):
    return tx(ROWS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("rule", ["D", "M", "Y"])
def test_a_range_gives_the_same_rows(spark, orders, rule):
    path = fresh_path(spark, "dated")
    assert dated.read_dated(spark, path) is None
    dated.write_dated(orders, path, rule, files=4)
    assert rows(dated.read_dated(spark, path)) == rows(orders)
    for start, end in (("2023-03-05", "2023-06-10"), ("2020-01-01", "2022-01-01"), ("2023-12-28", "2024-05-01"), ("2023-05-05", "2023-05-05")):
        for whole in (False, True):
            found = dated.read_dated(spark, path, start, end, whole)
            assert found.columns == orders.columns
            assert rows(found) == rows(cleaning.date_range(orders, start, end, whole))


def test_a_range_reads_its_files_only(spark, orders):
    path = fresh_path(spark, "dated")
    dated.write_dated(orders, path, "M", files=6)
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    few, all_ = (dated.read_dated(spark, path, "2023-04-01", end) for end in ("2023-05-20", None))
    assert files(few) < files(all_) / 3
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "PushedFilters: [IsNotNull(transaction_date)" in plan


def test_missing_far_and_repeated_dates(spark):
    given = [(1, None, 1.0), (2, "9999-12-31", 2.0), (3, "0001-01-01", 3.0)] + [(4, "2023-01-01", 4.0)] * 100
    frame = spark.createDataFrame(given, "customer_id INT, d STRING, amount DOUBLE")
    frame = frame.select("customer_id", F.to_timestamp("d").alias("transaction_date"), "amount")
    path = fresh_path(spark, "dated")
    dated.write_dated(frame, path, "Y", files=3)
    read = dated.read_dated(spark, path)
    assert read.count() == 103 and read.where("transaction_date is null").count() == 1
    for start, end in (("0001-01-01", "9999-12-31"), ("2023-01-01", "2023-01-01")):
        assert dated.read_dated(spark, path, start, end).count() == cleaning.date_range(frame, start, end).count()
    dated.write_dated(frame.limit(0), path)
    with pytest.raises(ValueError):
        dated.write_dated(frame.withColumn("period", F.lit(1)), path)


@pytest.mark.parametrize("rule", ["D", "W", "M"])
def test_sketches_follow_the_exact_trend(orders, rule):
    daily = sketches.daily_sketches(orders)
    exact = {r[0]: r for r in trends.trend(orders, rule).collect()}
    found = {r[0]: r for r in sketches.trend_of_days(daily, rule).collect()}
    assert found.keys() == exact.keys()
    for day, row in found.items():
        assert (row.revenue, row.transactions) == (exact[day].revenue, exact[day].transactions)
        assert abs(row.active_customers - exact[day].active_customers) <= 0.03 * exact[day].active_customers


def test_sketches_of_many_customers_of_any_type(spark):
    for kind in ("bigint", "string", "double", "date"):
        value = F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")) if kind == "date" else F.col("id").cast(kind)
        moment = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 40 * 86400)
        df = spark.range(60_000).select(value.alias("customer_id"), moment.alias("transaction_date"), F.lit(1).alias("amount"))
        daily = sketches.daily_sketches(df.unionAll(df))
        found = sketches.kpi_of_days(daily).first()
        assert found.rows == 120_000 and abs(found.customers - 60_000) <= 0.03 * 60_000
        part = sketches.kpi_of_days(daily, "2023-11-20", "2023-11-29").first()
        assert abs(part.customers - 15_000) <= 0.03 * 15_000


def test_sketches_of_nothing(spark, tx):
    daily = sketches.daily_sketches(tx(ROWS[:1]).limit(0))
    assert tuple(sketches.kpi_of_days(daily).first()) == (0, 0, 0.0, None)
    assert sketches.trend_of_days(daily, "D").collect() == []
