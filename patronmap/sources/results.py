"""Stored results: Parquet scan, export of everything available, dataset catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from patronmap.operators.segments import customers_of_segment
from patronmap.schema import CUSTOMER, DATE, LABEL
from patronmap.sources.delimited import write_delimited
from patronmap.sources.mapping import ColumnMapping
from patronmap.sources.versions import Outdated, current, read_version, write_version
from patronmap.storage import delete_folder


def read_result(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored result, or None if there is none; a damaged file is an error."""
    return read_version(spark, path)


def result_path(folder: str, dataset_id: str, kind: str) -> str:
    """Where the result of a kind, such as rfm or clusters, of a dataset is stored."""
    return f"{folder}/{dataset_id}_{kind}.parquet"


def store_result(df: DataFrame, folder: str, dataset_id: str, kind: str) -> None:
    """Store a result of a dataset, in place of an earlier one, which stays if this fails."""
    write_version(df, result_path(folder, dataset_id, kind))


def stored_result(
    spark: SparkSession, folder: str, dataset_id: str, kind: str
) -> DataFrame | None:
    return read_result(spark, result_path(folder, dataset_id, kind))


def export_segment(
    segments: DataFrame, metrics: DataFrame, value: object, path: str, segment: str = LABEL
) -> None:
    """Write the customers of one segment with their metrics, one delimited row each."""
    chosen = customers_of_segment(segments, value, segment)
    write_delimited(chosen.join(metrics, CUSTOMER, "left"), path)


def export_available(
    spark: SparkSession, tables: Mapping[str, DataFrame | None], path: str
) -> DataFrame:
    """Write every table that exists and is not empty to its own folder; list them with rows.

    Rows are counted while they are written, not in a pass of their own.
    """
    written = []
    for name, df in tables.items():
        if df is None:
            continue
        seen = Observation()
        write_delimited(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{path}/{name}")
        rows = seen.get["rows"]
        if rows:
            written.append((name, rows))
        else:
            delete_folder(spark, f"{path}/{name}")
    return spark.createDataFrame(written, "`table` STRING, `rows` BIGINT")


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: rows, customers, first and last date."""
    per_customer = df.groupBy(CUSTOMER).agg(
        F.count(F.lit(1)).alias("rows"), F.min(DATE).alias("first"), F.max(DATE).alias("last")
    )
    return per_customer.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count(CUSTOMER).alias("customers"),
        F.min("first").alias("min_date"),
        F.max("last").alias("max_date"),
    )


def register_dataset(
    df: DataFrame, dataset_id: str, original_name: str, mapping: ColumnMapping, catalog: str
) -> None:
    """Put the profile of a dataset into the catalog table at `catalog`, in place of an earlier one.

    If other entries were registered meanwhile, the catalog is read again.
    """
    parts = [F.lit(v).cast("string").alias(k) for k, v in mapping.to_dict().items()]
    entry = dataset_profile(df).select(
        F.lit(dataset_id).alias("id"),
        F.current_timestamp().alias("created_at"),
        F.lit(original_name).alias("original_name"),
        "rows",
        "customers",
        "min_date",
        "max_date",
        F.struct(*parts).alias("mapping"),
    )
    spark = df.sparkSession
    entry = spark.createDataFrame(entry.collect(), entry.schema)  # one row
    while True:
        before = current(spark, catalog)
        known = read_version(spark, catalog)
        others = entry if known is None else known.where(F.col("id") != dataset_id).unionByName(entry)
        try:
            write_version(others.coalesce(1), catalog, before, derived=True)
            return
        except Outdated:
            continue


def read_catalog(spark: SparkSession, catalog: str) -> DataFrame | None:
    """Known datasets, the newest first."""
    known = read_result(spark, catalog)
    return None if known is None else known.orderBy(F.desc("created_at"), "id")

