"""Transactions stored by calendar period, so that a date range reads its own files only.

Every period is a folder; inside, files are sorted by date, so that the smallest and largest
date of a file's row groups leave out more. Rows are dealt to tasks by range of date; rows of one
moment are spread by a hash, so a moment with a third of all rows fills many files. Rows without a
date are kept, in a folder that no range reads. Tables are replaced in one step (`versions`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronmap.operators.cleaning import date_range
from patronmap.schema import DATE
from patronmap.sources.versions import Version, current, publish

PERIOD = "period"
# Texts of a period, in which order is that of time; negative years and those beyond 9999 share one.
FORMATS = {"D": "yyyy-MM-dd", "M": "yyyy-MM", "Y": "yyyy"}
FAR = "far"


def _period(rule: str, moment: Column) -> Column:
    year = F.year(moment)
    return F.when((year >= 0) & (year <= 9999), F.date_format(moment, FORMATS[rule])).when(moment.isNotNull(), F.lit(FAR))


def write_dated(transactions: DataFrame, path: str, rule: str = "M", files: int | None = None) -> Version:
    """Publish transactions with a timestamp column by day, month or year, in about `files` files."""
    spark = transactions.sparkSession
    if PERIOD in transactions.columns:
        raise ValueError(f"a column {PERIOD} is already there")
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The number of a row follows from the files read, so a lost task deals its rows as before.
    spread = F.xxhash64(F.monotonically_increasing_id())
    rows = transactions.withColumns({PERIOD: _period(rule, F.col(DATE)), "_spread": spread})
    rows = rows.repartitionByRange(parts, DATE, "_spread").sortWithinPartitions(PERIOD, DATE).drop("_spread")
    write = lambda folder: rows.write.partitionBy(PERIOD).parquet(folder)
    return publish(spark, path, write, note=f"-{rule}")


def read_dated(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, end_of_day: bool = False
) -> DataFrame | None:
    """The stored transactions, or those of a date range as `date_range` has it; None if there are none."""
    version = current(spark, path)
    if version is None:
        return None
    rule = version.path.rsplit("-", 1)[1]
    # Without a given type, texts such as 2024 would be read back as numbers.
    fields = [T.StructField(PERIOD, T.StringType()) if f.name == PERIOD else f for f in spark.read.parquet(version.path).schema]
    rows = spark.read.schema(T.StructType(fields)).parquet(version.path)
    if start is None or end is None:
        return rows.drop(PERIOD)
    first, last = (_literal(spark, rule, moment) for moment in (start, end))
    chosen = rows.where((F.col(PERIOD) >= first) & (F.col(PERIOD) <= last)) if first and last else rows
    return date_range(chosen, start, end, end_of_day).drop(PERIOD)


def _literal(spark: SparkSession, rule: str, moment: str) -> str | None:
    """The period of a date as text, or None where periods don't follow one another as texts."""
    found = spark.range(1).select(_period(rule, F.lit(moment).cast("timestamp"))).first()[0]
    return None if found == FAR else found
