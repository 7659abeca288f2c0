"""From raw transactions to labelled customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronmap.operators.cleaning import clean
from patronmap.operators.rfm import add_weighted_scores, compute_rfm, label_segments, score_rfm
from patronmap.schema import LABEL
from patronmap.settings import Settings
from patronmap.storage import store


def customer_metrics(transactions: DataFrame, snapshot: str) -> DataFrame:
    """Metrics per customer, written once: the only pass over the transactions."""
    return store(compute_rfm(clean(transactions), snapshot), "rfm")


def scored_customers(transactions: DataFrame, snapshot: str) -> DataFrame:
    return score_rfm(customer_metrics(transactions, snapshot), stored=True)


def labelled_customers(
    transactions: DataFrame, snapshot: str, settings: Settings | None = None
) -> DataFrame:
    settings = settings or Settings()
    weighted = add_weighted_scores(scored_customers(transactions, snapshot), settings.rfm_weights)
    return label_segments(weighted, settings.rfm_weights, settings.segment_rules)


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(LABEL).agg(F.count(F.lit(1)).alias("customers"))
