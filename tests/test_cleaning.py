from __future__ import annotations

import datetime as dt

import pytest

from patronmap.operators.cleaning import clean, clean_light, coerce, date_range

TEXT = "customer_id STRING, transaction_date STRING, amount STRING"


def test_invalid_rows_are_removed(spark):
    rows = [(1, "2023-01-01", 100.0), (2, None, -50.0)]
    schema = "customer_id BIGINT, transaction_date STRING, amount DOUBLE"
    kept = clean(spark.createDataFrame(rows, schema)).collect()
    assert [r.amount for r in kept] == [100.0]


@pytest.mark.parametrize(
    "row, light, full",
    [
        (("a", "2023-01-01", "5"), True, True),
        ((None, "2023-01-01", "5"), False, False),
        (("", "2023-01-01", "5"), True, False),
        (("   ", "2023-01-01", "5"), True, False),
        ((" \t", "2023-01-01", "5"), True, False),
        (("\x1c", "2023-01-01", "5"), True, False),
        ((" a ", "2023-01-01", "5"), True, True),
        (("a", "yesterday", "5"), False, False),
        (("a", "10:30", "5"), False, False),
        (("a", "2023-01-01T10:30:00", "5"), True, True),
        (("a", "2023-01-01", "abc"), False, False),
        (("a", "2023-01-01", "nan"), False, False),
        (("a", "2023-01-01", "1d"), False, False),
        (("a", "2023-01-01", "1.F "), False, False),
        (("a", "2023-01-01", "0x1p3"), False, False),
        (("a", "2023-01-01", "1,000"), False, False),
        (("a", "2023-01-01", "1_000"), False, False),
        (("a", "2023-01-01", " 2 "), True, True),
        (("a", "2023-01-01", "+1e3"), True, True),
        (("a", "2023-01-01", "0"), True, False),
        (("a", "2023-01-01", "-1"), True, False),
        (("a", "2023-01-01", "inf"), True, True),
    ],
)
def test_each_rule(spark, row, light, full):
    raw = spark.createDataFrame([row], TEXT)
    assert (clean_light(raw).count() == 1) is light
    assert (clean(raw).count() == 1) is full


def test_nan_is_missing(spark):
    schema = "customer_id BIGINT, transaction_date STRING, amount DOUBLE"
    raw = spark.createDataFrame([(1, "2023-01-01", float("nan")), (2, "2023-01-01", 1.0)], schema)
    assert [r.customer_id for r in clean_light(raw).collect()] == [2]


def test_customer_is_not_trimmed(spark):
    raw = spark.createDataFrame([(" a ", "2023-01-01", "5")], TEXT)
    assert clean(raw).first().customer_id == " a "


def test_every_date_is_read_by_itself(spark):
    days = ["2023-01-02", "2023-01-02 03:04:05", "02.01.2023", "2023/01/02"]
    raw = spark.createDataFrame([("a", d, "1") for d in days], TEXT)
    read = [r.transaction_date for r in coerce(raw, ("dd.MM.yyyy",)).collect()]
    assert read == [
        dt.datetime(2023, 1, 2),
        dt.datetime(2023, 1, 2, 3, 4, 5),
        dt.datetime(2023, 1, 2),
        None,
    ]


def test_types_that_are_not_text_stay(spark):
    raw = spark.sql(
        "SELECT 1 AS customer_id, DATE '2023-01-01' AS transaction_date,"
        " CAST(1.5 AS DECIMAL(18,2)) AS amount"
    )
    assert dict(coerce(raw).dtypes) == {
        "customer_id": "int",
        "transaction_date": "timestamp",
        "amount": "decimal(18,2)",
    }


def test_end_date_means_its_midnight(tx):
    rows = [(1, "2023-01-01 00:00:00", 1.0), (2, "2023-01-02 00:00:00", 1.0)]
    rows += [(3, "2023-01-02 09:00:00", 1.0), (4, "2023-01-03 00:00:00", 1.0)]
    chosen = date_range(tx(rows), "2023-01-01", "2023-01-02")
    assert sorted(r.customer_id for r in chosen.collect()) == [1, 2]
    whole = date_range(tx(rows), "2023-01-01", "2023-01-02", end_of_day=True)
    assert sorted(r.customer_id for r in whole.collect()) == [1, 2, 3]
