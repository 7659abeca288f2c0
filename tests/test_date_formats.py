from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from patronmap.operators import cleaning, date_formats, trends
from patronmap.sources import delimited, mapping

DAYS = [dt.datetime(2022, 1, 1) + dt.timedelta(days=17 * i, hours=i % 24, minutes=i % 60) for i in range(80)]


def column(spark, texts):
    rows = [(i, t, 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "customer_id INT, transaction_date STRING, amount DOUBLE")


@pytest.mark.parametrize("pattern", ["%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y %H:%M", "%m-%d-%Y %H:%M:%S", "%Y/%m/%d", "%d %b %Y", "%d/%m/%y", "%m/%d/%y %H:%M"])
def test_columns_are_told_apart(spark, pattern):
    texts = [d.strftime(pattern) for d in DAYS]
    found = date_formats.coerce_column(column(spark, [*texts, None, " ", "no date"])).orderBy("customer_id").collect()
    assert [r.transaction_date for r in found] == [dt.datetime.strptime(t, pattern) for t in texts] + [None] * 3


def test_digits_without_zeros_and_iso_rows_between(spark):
    texts = ["1/13/2023 8:05", "2/1/2023 18:30", "2023-05-06", "2023-05-06T07:08:09"]
    found = date_formats.coerce_column(column(spark, texts)).orderBy("customer_id").collect()
    expected = [dt.datetime(2023, 1, 13, 8, 5), dt.datetime(2023, 2, 1, 18, 30), dt.datetime(2023, 5, 6), dt.datetime(2023, 5, 6, 7, 8, 9)]
    assert [r.transaction_date for r in found] == expected


def test_one_value_decides_and_a_tie_is_month_first(spark):
    many = ["01/02/2023"] * 500
    assert date_formats.detect_date_format(column(spark, [*many, "13/02/2023"])).startswith("d/M")
    assert date_formats.detect_date_format(column(spark, [*many, "02/13/2023"])).startswith("M/d")
    assert date_formats.detect_date_format(column(spark, many)).startswith("M/d")


def test_iso_other_types_and_nothing_need_no_format(spark, tx):
    assert date_formats.detect_date_format(column(spark, ["2023-01-02", "2023-01-13 10:00:00"])) is None
    assert date_formats.detect_date_format(column(spark, [None, "", "x"])) is None
    assert date_formats.detect_date_format(column(spark, []).limit(0)) is None
    assert date_formats.detect_date_format(tx([(1, "2023-01-01", 1.0)])) is None


def test_a_file_without_given_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("c;d;a\n1;31.12.2022 23:59;2\n2;1.2.2023 0:00;3\n")
    names = mapping.ColumnMapping("c", "d", "a")
    found = delimited.read_transactions(spark, str(tmp_path), names, formats=None).orderBy("customer_id").collect()
    assert [r.transaction_date for r in found] == [dt.datetime(2022, 12, 31, 23, 59), dt.datetime(2023, 2, 1)]


def test_dates_beyond_64_bit_nanoseconds_are_missing(spark):
    texts = ["9999-12-31", "1677-09-21 00:12:43.145225", "1677-09-21 00:12:43.145224", "2262-04-11 23:47:16.854775", "2262-04-11 23:47:16.854776", "2023-01-05"]
    frame = column(spark, texts)
    kept = cleaning.clean_light(frame)
    assert sorted(r.customer_id for r in kept.collect()) == [1, 3, 5]
    assert trends.trend(kept.where("customer_id = 5"), "D").count() == 1
    dates = frame.withColumn("transaction_date", F.to_date(F.substring("transaction_date", 1, 10)))
    assert sorted(r.customer_id for r in cleaning.clean_light(dates).collect()) == [3, 4, 5]
