"""The given tables as transactions and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronmap.schema import AMOUNT, CLUSTER, CUSTOMER, DATE, LABEL

SNAPSHOT = "2001-08-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(money: Column) -> Column:
    """Whole cents: their sums are exact, so no result depends on the order of rows."""
    return F.rint(money * 100.0).cast("bigint")


def tx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions, amounts in cents."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias(CUSTOMER),
        F.col("o_orderdate").alias(DATE),
        cents(F.col("o_totalprice")).alias(AMOUNT),
    )


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions, with a time of day and a few amounts that are not positive; in cents."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias(CUSTOMER),
        F.col("ts").alias(DATE),
        cents(F.col("value")).alias(AMOUNT),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under the headings of an invoice file; quantities are text."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("Customer ID"),
        F.col("o_orderdate").alias("InvoiceDate"),
        F.col("l_quantity").cast("string").alias("Quantity"),
        F.col("l_extendedprice").alias("Price"),
    )


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as text, damaged in a way that follows from its key."""
    key = F.col("o_orderkey")
    customer, amount = F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 11 == 1, None)
        .when(key % 11 == 2, "")
        .when(key % 11 == 3, " \t ")
        .when(key % 11 == 4, "\u00a0")
        .when(key % 11 == 5, F.concat(F.lit(" "), customer))
        .otherwise(customer)
        .alias(CUSTOMER),
        F.when(key % 7 == 1, F.concat(day, F.lit("T10:30:00")))
        .when(key % 7 == 2, F.date_format("o_orderdate", "dd.MM.yyyy"))
        .when(key % 7 == 3, "not a date")
        .when(key % 7 == 4, "10:30")
        .when(key % 7 == 5, F.concat(day, F.lit(" 23:59:59.25")))
        .otherwise(day)
        .alias(DATE),
        F.when(key % 13 == 1, "abc")
        .when(key % 13 == 2, F.concat(amount, F.lit("d")))
        .when(key % 13 == 3, "nan")
        .when(key % 13 == 4, "0")
        .when(key % 13 == 5, F.concat(F.lit("-"), amount))
        .when(key % 13 == 6, F.concat(F.lit(" "), amount, F.lit(" ")))
        .when(key % 13 == 7, "1,000")
        .when(key % 13 == 8, "1e3")
        .when(key % 13 == 9, "0x1p3")
        .otherwise(amount)
        .alias(AMOUNT),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment per customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(CUSTOMER),
        F.col("c_nationkey").alias(CLUSTER),
        F.col("c_mktsegment").alias(LABEL),
    )


def segments_in_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment per customer in credit; the others have none, which the join must keep."""
    in_credit = table(spark, sf_dir, "customer").where(F.col("c_acctbal") >= 0)
    return segments(spark, sf_dir).join(in_credit, F.col(CUSTOMER) == F.col("c_custkey"), "left_semi")


def order_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several segment rows per customer: one per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias(CUSTOMER),
        F.substring("o_orderpriority", 1, 1).cast("int").alias(CLUSTER),
        F.col("o_orderpriority").alias(LABEL),
    )


def segment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per market segment, written from the customers in it."""
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_mktsegment").alias(LABEL))
        .agg(F.max("c_name").alias("_name"))
        .select(LABEL, F.concat(F.lit("Write to "), "_name").alias("recommendation"))
    )
