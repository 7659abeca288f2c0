from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import as_dict
from patronmap.operators import ranking
from patronmap.operators.ranking import quantile_cuts, rank_metrics
from patronmap.operators.rfm import (
    add_weighted_scores, compute_rfm, label_segments, rfm_ranks, score_rfm,
)

RFM = "customer_id BIGINT, recency BIGINT, frequency BIGINT, monetary DOUBLE"


def test_several_purchases(tx):
    rows = [(7, "2024-03-02", 12.5), (7, "2024-02-20", 7.5), (7, "2024-02-20", 5.0), (9, "2024-01-31", 40.0)]
    got = as_dict(compute_rfm(tx(rows), "2024-03-05"), "customer_id")
    assert tuple(got[7]) == (7, 3, 3, 25.0)
    assert tuple(got[9]) == (9, 34, 1, 40.0)


def test_single_purchase(tx):
    only = compute_rfm(tx([(4, "2024-05-30", 3.25)]), "2024-06-02").collect()
    assert [tuple(r) for r in only] == [(4, 3, 1, 3.25)]


def test_empty_keeps_schema(tx):
    nothing = compute_rfm(tx([]), "2023-01-10")
    assert nothing.count() == 0
    assert nothing.columns == ["customer_id", "recency", "frequency", "monetary"]
    assert score_rfm(nothing).count() == 0


def test_outliers_are_summed(tx):
    rows = [(3, "2024-01-01", 0.5), (3, "2024-01-03", 7_500_000.0)]
    assert compute_rfm(tx(rows), "2024-01-10").first().monetary == 7_500_000.5


@pytest.mark.parametrize(
    "last, days",
    [("2023-01-09 23:00:00", 0), ("2023-01-10 00:00:00", 0), ("2023-01-10 01:00:00", -1),
     ("2023-01-08 23:00:00", 1), ("2023-01-11 00:00:01", -2)],
)
def test_recency_counts_elapsed_days(tx, last, days):
    assert compute_rfm(tx([(1, last, 1.0)]), "2023-01-10").first().recency == days


def test_missing_amounts_and_customers(spark):
    raw = spark.sql(
        "SELECT * FROM VALUES (1, TIMESTAMP '2023-01-01', CAST(NULL AS DOUBLE)),"
        " (NULL, TIMESTAMP '2023-01-01', 5D) AS t(customer_id, transaction_date, amount)"
    )
    assert [tuple(r) for r in compute_rfm(raw, "2023-01-02").collect()] == [(1, 1, 1, 0.0)]


def test_decimal_sums_are_exact(spark):
    raw = spark.range(1000).select(
        F.lit("x").alias("customer_id"),
        F.lit("2023-01-01").cast("timestamp").alias("transaction_date"),
        F.lit(Decimal("0.10")).alias("amount"),
    )
    assert compute_rfm(raw, "2023-01-02").first().monetary == 100.0


# Sizes of the five bins for n distinct values, as linear quantiles of the rank give them.
@pytest.mark.parametrize(
    "n, sizes",
    [(1, [1, 0, 0, 0, 0]), (2, [1, 0, 0, 0, 1]), (5, [1, 1, 1, 1, 1]), (6, [2, 1, 1, 1, 1]),
     (7, [2, 1, 1, 1, 2]), (9, [2, 2, 1, 2, 2])],
)
def test_bins(spark, n, sizes):
    rows = [(i, i, i, float(i)) for i in range(n)]
    scored = score_rfm(spark.createDataFrame(rows, RFM)).collect()
    for score, expected in (("F_score", sizes), ("M_score", sizes), ("R_score", sizes[::-1])):
        assert [sum(r[score] == b for r in scored) for b in range(1, 6)] == expected


def test_ties_are_split_by_customer(spark):
    rows = [(i, 7, 7, 7.0) for i in range(10)]
    scored = as_dict(score_rfm(spark.createDataFrame(rows, RFM)), "customer_id")
    assert [scored[i].F_score for i in range(10)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert [scored[i].RFM_score for i in (0, 9)] == ["511", "155"]
    assert scored[9].RFM_sum == 11


def test_text_customers_can_be_scored(spark):
    rows = [(f"c{i}", i, 1, 1.0) for i in range(10)]
    frame = spark.createDataFrame(rows, RFM.replace("BIGINT", "STRING", 1))
    scored = as_dict(score_rfm(frame), "customer_id")
    assert [scored[f"c{i}"].F_score for i in range(10)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def skewed(spark, n=20_000):
    """A third of the customers share one value of every metric."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        (F.col("id") * 7919 % n).alias("customer_id"),
        F.when(hot, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(400))).alias("recency"),
        F.when(hot, 1).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30))).alias("frequency"),
        F.when(hot, 0.5).otherwise(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9999)) / 7.0)
        .alias("monetary"),
    )


@pytest.mark.parametrize("partitions", [1, 13])
def test_distributed_rank_equals_global_rank(spark, partitions):
    rfm = skewed(spark).repartition(partitions)
    ranks = rfm_ranks(rfm)
    for metric in ("recency", "frequency", "monetary"):
        whole = Window.orderBy(metric, "customer_id")
        expected = rfm.select("customer_id", F.row_number().over(whole).alias("r"))
        joined = expected.join(ranks, "customer_id")
        assert joined.count() == 20_000
        assert joined.where(F.col("r") != F.col(f"{metric}_rank")).count() == 0


def test_hot_value_is_spread_over_ranges(spark):
    """Adaptive execution joins small ranges; without it they show as they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = rank_metrics(skewed(spark), ["frequency"], "customer_id").frame
        sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 20_000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("margin", [None, -0.05])
def test_cuts_follow_the_rank_formula(spark, monkeypatch, margin):
    """Also where the probes miss the ends."""
    if margin is not None:
        monkeypatch.setattr(ranking, "PROBE_MARGIN", margin)
    rfm = skewed(spark).cache()
    metrics = ["recency", "frequency", "monetary"]
    ranked = rank_metrics(rfm, metrics, "customer_id")
    key_type = rfm.schema["customer_id"].dataType
    for cuts in quantile_cuts(rfm, metrics, "customer_id"):
        n = ranked.sizes[cuts.metric]
        bins = rfm.select("customer_id", cuts.bin("customer_id", key_type).alias("bin"))
        ranks = ranked.frame.where(F.col("metric") == cuts.metric)
        formula = F.greatest(F.lit(1), F.ceil((F.col("rank") - 1) * 5 / (n - 1)))
        assert n == 20_000 and len(cuts.ends) == 4
        assert bins.join(ranks, "customer_id").where(F.col("bin") != formula).count() == 0
    rfm.unpersist()


def test_narrowing_sorts_few_rows(spark, monkeypatch):
    sorted_rows = []
    whole = ranking.checkpoint

    def watched(df):
        done = whole(df)
        sorted_rows.append(done.count())
        return done

    monkeypatch.setattr(ranking, "checkpoint", watched)
    distinct = spark.range(50_000).select(
        F.col("id").alias("customer_id"), F.xxhash64("id").cast("double").alias("monetary")
    )
    quantile_cuts(distinct, ["monetary"], "customer_id")
    assert sorted_rows[0] < 50_000 / 20


def test_missing_metrics_have_no_score(spark):
    rows = [(1, 1, 1, 1.0), (2, None, 2, float("nan")), (3, 3, 3, 3.0)]
    scored = as_dict(score_rfm(spark.createDataFrame(rows, RFM)), "customer_id")
    assert (scored[2].R_score, scored[2].F_score, scored[2].M_score) == (None, 3, None)
    assert (scored[1].R_score, scored[3].R_score) == (5, 1)


ALL_SCORES = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]

# The label by R (rows) and F + M from 2 to 10 (columns), for equal weights.
NAMES = {
    "v": "VIP / Champions", "l": "Loyal / Active", "p": "Potential Loyalists", "a": "At Risk",
    "x": "Lost", "n": "New", "r": "Regular",
}
LABELS = {5: "nnnrllvvv", 4: "nnnrllvvv", 3: "rrrrppppp", 2: "xxxrraaaa", 1: "xxxrraaaa"}


@pytest.mark.parametrize("weight", [1.0, 2.0, 0.5])
def test_labels_of_all_scores(spark, weight):
    """Weights that are all the same change nothing."""
    weights = dict.fromkeys("RFM", weight)
    scores = spark.createDataFrame(ALL_SCORES, "R_score INT, F_score INT, M_score INT")
    labelled = label_segments(add_weighted_scores(scores, weights), weights).collect()
    assert len(labelled) == 125
    for row in labelled:
        r, fm = row.R_score, row.F_score + row.M_score
        assert row.Segment_label == NAMES[LABELS[r][fm - 2]], (r, fm)


def test_without_weights_everyone_is_on_top(spark):
    weights = dict.fromkeys("RFM", 0.0)
    scores = spark.createDataFrame(ALL_SCORES, "R_score INT, F_score INT, M_score INT")
    labelled = label_segments(add_weighted_scores(scores, weights), weights)
    assert {r.Segment_label for r in labelled.collect()} == {"VIP / Champions"}


def test_exact_limit_can_be_missed_by_rounding(spark):
    weights = {"R": 0.7}
    scores = spark.createDataFrame([(4, 5, 5)], "R_score INT, F_score INT, M_score INT")
    row = label_segments(add_weighted_scores(scores, weights), weights).first()
    assert row.Segment_label == "Potential Loyalists"


def test_missing_weight_counts_one(spark):
    scores = spark.createDataFrame([(2, 3, 4)], "R_score INT, F_score INT, M_score INT")
    row = add_weighted_scores(scores, {"R": 2}).first()
    assert (row.R_weighted, row.F_weighted, row.M_weighted) == (4.0, 3.0, 4.0)
    assert (row.FM_weighted, row.RFM_weighted_sum) == (7.0, 11.0)


def test_rules_can_be_changed(spark):
    scores = spark.createDataFrame([(3, 5, 5)], "R_score INT, F_score INT, M_score INT")
    weighted = add_weighted_scores(scores, None)
    assert label_segments(weighted, None).first().Segment_label == "Potential Loyalists"
    changed = label_segments(weighted, None, {"vip_r_min": 0.6})
    assert changed.first().Segment_label == "VIP / Champions"
