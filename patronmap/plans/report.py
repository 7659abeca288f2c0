"""Report over transactions and whatever results have been stored for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from patronmap.operators.cleaning import clean_light
from patronmap.operators.report import report_insights, report_summary
from patronmap.sources.results import export_available, read_result, result_path


@dataclass(frozen=True)
class Report:
    summary: DataFrame
    insights: DataFrame
    tables: dict[str, DataFrame | None]

    def export(self, spark: SparkSession, path: str) -> DataFrame:
        return export_available(spark, self.tables, path)


def build_report(
    spark: SparkSession,
    transactions: DataFrame,
    rfm: DataFrame | None = None,
    clusters: DataFrame | None = None,
    rfm_path: str | None = None,
    clusters_path: str | None = None,
    dataset_id: str | None = None,
    results_folder: str | None = None,
) -> Report:
    """Results given as frames win over stored ones; either may be missing.

    Stored ones lie at the given paths, or are those of a dataset in a folder of results.
    """
    cleaned = clean_light(transactions)
    if dataset_id is not None and results_folder is not None:
        rfm_path = rfm_path or result_path(results_folder, dataset_id, "rfm")
        clusters_path = clusters_path or result_path(results_folder, dataset_id, "clusters")
    if rfm is None and rfm_path is not None:
        rfm = read_result(spark, rfm_path)
    if clusters is None and clusters_path is not None:
        clusters = read_result(spark, clusters_path)
    return Report(
        summary=report_summary(cleaned, rfm, clusters),
        insights=report_insights(cleaned),
        tables={"transactions": cleaned, "rfm": rfm, "clusters": clusters},
    )
