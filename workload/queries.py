"""One query per operator; each reads whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronmap.operators import cleaning, clustering, date_formats, growth, linkage, report, rfm, segments, sketches, trends
from patronmap.operators.features import prepare_features
from patronmap.operators.silhouette import EUCLIDEAN, SQUARED_EUCLIDEAN, silhouette
from patronmap.operators.rfm_state import RfmState
from patronmap.plans import customers as plan
from patronmap.plans.clusters import segment
from patronmap.plans.report import build_report
from patronmap.schema import AMOUNT, CLUSTER, CUSTOMER, DATE, LABEL, RFM_METRICS, SCORES
from patronmap.settings import DBSCAN, HIERARCHICAL, KMEANS, MINMAX_SCALER, STANDARD_SCALER
from patronmap.settings import SegmentRules, Settings, Weights
from patronmap.sources import dated, delimited, mapping, results
from patronmap.storage import fresh_path, store
from workload import tables as t
from workload.tables import SNAPSHOT

# Fixed values of the registered queries; the SQL uses the same.
WEIGHTS = Weights(R=1.3, F=1.0, M=1.0)
RULES = SegmentRules(vip_r_min=0.7, risk_r_max=0.5, new_fm_max=0.5)
SCORE_CENTRES = ((1.0, 1.0, 1.0), (1.0, 5.0, 5.0), (3.0, 3.0, 3.0), (5.0, 1.0, 1.0), (5.0, 5.0, 5.0))
METRIC_CENTRES = ((-0.5, -1.0, -1.0), (-0.5, 1.0, 1.0), (2.0, -1.0, -1.0))
RANGE = ("2024-01-05", "2024-01-20")
SKETCH_START, SKETCH_ENDS = "1995-01-10", ("1995-02-01", "1996-06-30", "2001-12-31")
FORMATS = ("dd.MM.yyyy",)
CHOSEN_SEGMENT = "BUILDING"
K = 4
EPS = 0.3
EPS_SIX = 0.8
LINK_HEIGHT = 0.15
MIN_SAMPLES = 5


# Sources and sinks


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "orders-csv")
    orders = t.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    delimited.write_delimited(orders, path, sep=";")
    names = mapping.ColumnMapping("o_custkey", "o_orderdate", "o_totalprice")
    return delimited.read_transactions(spark, path, names)


def csv_scan_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under a description with quotes, separators and line breaks, as customers."""
    path = fresh_path(spark, "lines-csv")
    said = F.concat(
        F.lit('order "'), F.col("l_orderkey").cast("string"), F.lit('";\nline, '), F.col("l_linenumber").cast("string"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("\r\n\n")).otherwise(F.lit("")),
    )
    lines = t.table(spark, sf_dir, "lineitem").select(
        said.alias("Description"), F.col("l_shipdate").alias("InvoiceDate"),
        F.col("l_quantity").alias("Quantity"), F.col("l_extendedprice").alias("Price"),
    )
    delimited.write_delimited(lines, path, sep=";", multi_line=True)
    names = mapping.ColumnMapping("Description", "InvoiceDate", qty_col="Quantity", price_col="Price")
    return delimited.read_transactions(spark, path, names).withColumn(AMOUNT, t.cents(F.col(AMOUNT)))


def detect_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written with every separator, each with a field that holds all of them."""
    people = t.table(spark, sf_dir, "customer").withColumn(
        "remark", F.concat("c_mktsegment", F.lit(",;|"), "c_name")
    )
    found = None
    for name, sep in (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("pipe", "|")):
        path = fresh_path(spark, f"customer-{name}")
        delimited.write_delimited(people, path, sep=sep, header=False)
        best = delimited.best_separator(spark, path).select(
            F.lit(name).alias("written"), (F.col("separator") == sep).alias("found"),
            "fields", "lines",
        )
        found = best if found is None else found.unionAll(best)
    return found


def map_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("Customer ID"),
        F.col("o_orderdate").alias("Invoice.Date"),
        F.col("o_totalprice").alias("Total `net`"),
        "o_orderstatus",
    )
    names = mapping.ColumnMapping("Customer ID", "Invoice.Date", "Total `net`")
    return mapping.map_columns(raw, names)


def amount_qty_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = mapping.ColumnMapping(
        "Customer ID", "InvoiceDate", qty_col="Quantity", price_col="Price"
    )
    computed = mapping.map_columns(t.raw_lines(spark, sf_dir), names)
    return computed.withColumn(AMOUNT, t.cents(F.col(AMOUNT)))


def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    if results.read_result(spark, f"{sf_dir}/absent.parquet") is not None:
        raise AssertionError("a missing result must read as none")
    return results.read_result(spark, f"{sf_dir}/customer.parquet")


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported transactions as text, the way another tool would see them."""
    path = fresh_path(spark, "transactions")
    delimited.write_delimited(cleaning.clean_light(t.tx_orders(spark, sf_dir)), path)
    return delimited.scan_delimited(spark, path, ",")


def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    transactions = t.tx_orders(spark, sf_dir)
    made = build_report(
        spark,
        transactions,
        rfm=plan.customer_metrics(transactions, SNAPSHOT),
        clusters_path=f"{sf_dir}/absent.parquet",
    )
    return made.export(spark, fresh_path(spark, "export"))


def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = fresh_path(spark, "catalog")
    names = mapping.ColumnMapping("o_custkey", "o_orderdate", "o_totalprice")
    transactions = cleaning.clean(t.tx_orders(spark, sf_dir))
    results.register_dataset(transactions, "orders", "orders.parquet", names, catalog)
    return results.read_catalog(spark, catalog).select(
        "id", "original_name", "rows", "customers", "min_date", "max_date",
        F.col("mapping.customer_col").alias("customer_col"),
    )


# Cleaning and filters


def coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cleaning.coerce(t.messy_orders(spark, sf_dir), FORMATS)
    return done.select("o_orderkey", DATE, F.nanvl(AMOUNT, F.lit(None)).alias(AMOUNT))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(t.messy_orders(spark, sf_dir), FORMATS)


def date_format_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders as texts in four formats: which one each column as a whole has, and what it reads."""
    orders = t.table(spark, sf_dir, "orders")
    out = None
    for name, pattern in (("day_first", "dd/MM/yyyy"), ("month_first", "MM/dd/yyyy"), ("dotted", "d.M.yyyy H:mm"), ("iso", "yyyy-MM-dd")):
        texts = orders.select(F.date_format("o_orderdate", pattern).alias(DATE))
        found = date_formats.choose_format(date_formats.date_votes(texts)).select(
            F.lit(name).alias("written"), F.coalesce("format", F.lit("iso")).alias("format"), "known", "readable",
            F.col("first").alias("min_date"), F.col("last").alias("max_date"),
        )
        out = found if out is None else out.unionAll(found)
    return out


def clean_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_light(t.messy_orders(spark, sf_dir), FORMATS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_light(t.tx_events(spark, sf_dir))


def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.date_range(_events(spark, sf_dir), *RANGE)


def date_range_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from a table stored by day, of which a range reads its days only."""
    path = fresh_path(spark, "events-by-day")
    dated.write_dated(_events(spark, sf_dir), path, "D")
    return dated.read_dated(spark, path, *RANGE)


def date_range_full_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = cleaning.date_range(_events(spark, sf_dir), *RANGE, end_of_day=True)
    return chosen


# Segments


def segments_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.attach_segments(_events(spark, sf_dir), None)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_light(t.tx_orders(spark, sf_dir))


def attach_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = t.segments_in_credit(spark, sf_dir)
    return segments.attach_segments(_orders(spark, sf_dir), known)


def dedup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.dedup_segments(t.order_priorities(spark, sf_dir))


def segments_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.distinct_segments(t.segments(spark, sf_dir))


def segment_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.customers_of_segment(t.segments(spark, sf_dir), CHOSEN_SEGMENT)


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = t.segment_texts(spark, sf_dir)
    return segments.recommend(t.segments(spark, sf_dir), texts).select(
        CUSTOMER, LABEL, "recommendation"
    )


# Aggregations


def rfm_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of all orders, put in year by year."""
    orders = t.tx_orders(spark, sf_dir)
    state = RfmState(spark, fresh_path(spark, "rfm-state"), buckets=8)
    first, last = orders.agg(F.min(F.year(DATE)), F.max(F.year(DATE))).first()
    for year in range(first, last + 1):
        state.update(orders.where(F.year(DATE) == year), year)
    return state.rfm(SNAPSHOT)


def compute_rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm.compute_rfm(cleaning.clean(t.tx_orders(spark, sf_dir)), SNAPSHOT)


def rfm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day around the snapshot: elapsed days differ from calendar days."""
    return rfm.compute_rfm(cleaning.clean(t.tx_events(spark, sf_dir)), "2024-01-30 12:00:00")


def kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.kpi(t.tx_orders(spark, sf_dir))


def kpi_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.kpi(cleaning.date_range(_events(spark, sf_dir), *RANGE))


def trend_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.trend(_orders(spark, sf_dir), "D")


def trend_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.trend(_events(spark, sf_dir), "W")


def trend_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.trend(_orders(spark, sf_dir), "M")


def _close(estimate: str, exact: str) -> Column:
    """Whether an estimate of customers is within 3 % of the exact number."""
    return F.abs(F.col(estimate) - F.col(exact)) <= 0.03 * F.col(exact)


def kpi_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPIs of growing ranges from one sketch per day, beside the exact ones of the same days."""
    orders = _orders(spark, sf_dir)
    daily = store(sketches.daily_sketches(orders), "sketches")
    out = None
    for end in SKETCH_ENDS:
        exact = trends.kpi(cleaning.date_range(orders, SKETCH_START, end, end_of_day=True)).withColumnRenamed("customers", "exact")
        found = sketches.kpi_of_days(daily, SKETCH_START, end).select("customers", "rows", "revenue", "avg_order")
        both = found.join(exact.select("exact"), how="cross").select(  # one row beside one row
            F.lit(end).alias("until"), F.col("exact").alias("customers"), _close("customers", "exact").alias("close"), "rows", "revenue", "avg_order"
        )
        out = both if out is None else out.unionAll(both)
    return out


def trend_month_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly trend from one sketch per day; customers are those of the exact trend, which must be close."""
    orders = _orders(spark, sf_dir)
    found = sketches.trend_of_days(store(sketches.daily_sketches(orders), "sketches"), "M")
    exact = trends.trend(orders, "M").select(DATE, F.col("active_customers").alias("exact"))
    return found.join(exact, DATE).select(
        DATE, "revenue", "transactions", F.col("exact").alias("active_customers"), "avg_order_value",
        _close("active_customers", "exact").alias("close"),
    )


def _activity(spark: SparkSession, sf_dir: str, rule: str | None) -> DataFrame:
    """Orders per customer and period, reduced before segments are joined."""
    reduced = trends.activity(_orders(spark, sf_dir), rule)
    return segments.attach_segments(reduced, t.segments(spark, sf_dir))


def segment_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.segment_trend(_activity(spark, sf_dir, "W"), "W")


def segment_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.segment_share(trends.segment_totals(_activity(spark, sf_dir, None)))


def segment_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = trends.segment_totals(_activity(spark, sf_dir, None), CLUSTER)
    return trends.segment_comparison(totals, CLUSTER)


def segment_comparison_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every segment in the sorted comparison, as its rows come."""
    totals = trends.segment_totals(_activity(spark, sf_dir, None), CLUSTER)
    come = trends.segment_comparison(totals, CLUSTER).withColumn("_at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("_at"))
    return come.select("segment", place.cast("bigint").alias("place"))


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = build_report(
        spark,
        t.tx_events(spark, sf_dir),
        rfm=plan.customer_metrics(t.tx_events(spark, sf_dir), "2024-02-01"),
        clusters_path=f"{sf_dir}/absent.parquet",
    )
    return made.summary


def report_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_insights(_orders(spark, sf_dir))


# Growth


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.month_segment_matrix(_activity(spark, sf_dir, "M"))


def month_segment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.month_label(_matrix(spark, sf_dir))


def month_segment_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.month_label(growth.month_segment_wide(_activity(spark, sf_dir, "M")))


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Round derived doubles, whose last bit depends on the order of a sum."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def segment_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = growth.segment_growth(_matrix(spark, sf_dir))
    return _rounded(growth.month_label(grown), "change")


def segment_growth_nofill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth per customer nation: at small scale some nations have months without orders."""
    matrix = growth.month_segment_matrix(_activity(spark, sf_dir, "M"), CLUSTER)
    return _rounded(growth.month_label(growth.segment_growth(matrix, "none")), "change")


def growth_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(growth.growth_rate(growth.segment_growth(_matrix(spark, sf_dir))), "mean_growth")


def growth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.growth_events(growth.segment_growth(_matrix(spark, sf_dir)))


def growth_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.growth_extremes(growth_events(spark, sf_dir))


def growth_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = growth.segment_growth(_matrix(spark, sf_dir))
    return _rounded(growth.growth_direction(grown), "mean_growth")


# Scores and labels


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.customer_metrics(t.tx_orders(spark, sf_dir), SNAPSHOT)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.scored_customers(t.tx_orders(spark, sf_dir), SNAPSHOT)


def rfm_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rfm.rfm_ranks(_metrics(spark, sf_dir))


def rfm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


def rfm_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = rfm.add_weighted_scores(_scores(spark, sf_dir), WEIGHTS)
    return weighted.select(
        CUSTOMER, "R_weighted", "F_weighted", "M_weighted", "FM_weighted", "RFM_weighted_sum"
    )


def rfm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = Settings(rfm_weights=WEIGHTS)
    labelled = plan.labelled_customers(t.tx_orders(spark, sf_dir), SNAPSHOT, settings)
    return labelled.select(CUSTOMER, "RFM_score", "RFM_sum", LABEL)


def rfm_segments_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = Settings(segment_rules=RULES)
    labelled = plan.labelled_customers(t.tx_orders(spark, sf_dir), SNAPSHOT, settings)
    return labelled.select(CUSTOMER, "RFM_score", LABEL)


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.label_counts(plan.labelled_customers(t.tx_orders(spark, sf_dir), SNAPSHOT))


# Features and clusters


def features_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = prepare_features(_metrics(spark, sf_dir), RFM_METRICS, STANDARD_SCALER, WEIGHTS)
    return _rounded(scaled, *RFM_METRICS)


def features_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    without_frequency = Weights(F=0.0)
    metrics = _metrics(spark, sf_dir)
    scaled = prepare_features(metrics, RFM_METRICS, MINMAX_SCALER, without_frequency)
    return _rounded(scaled, *RFM_METRICS)


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = clustering.scaled_table(_metrics(spark, sf_dir), RFM_METRICS)
    assigned = clustering.assign_nearest(scaled, RFM_METRICS, METRIC_CENTRES)
    return assigned.select(CUSTOMER, CLUSTER)


def kmeans_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(_metrics(spark, sf_dir), KMEANS, RFM_METRICS, k=K)


def hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(_metrics(spark, sf_dir), HIERARCHICAL, RFM_METRICS, k=K)


def dbscan_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment(
        _metrics(spark, sf_dir), DBSCAN, RFM_METRICS, eps=EPS, min_samples=MIN_SAMPLES
    )
    return found.select(CUSTOMER, CLUSTER)


def hierarchical_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact single linkage of all customers, cut at a height."""
    scaled = clustering.scaled_table(_metrics(spark, sf_dir), RFM_METRICS)
    merges = linkage.single_linkage(scaled, RFM_METRICS)
    return linkage.cut(scaled, merges, RFM_METRICS, LINK_HEIGHT).select(CUSTOMER, CLUSTER)


def dbscan_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clustering along metrics and scores, beyond the axes of a block lookup."""
    found = segment(_scores(spark, sf_dir), DBSCAN, (*RFM_METRICS, *SCORES), eps=EPS_SIX, min_samples=MIN_SAMPLES)
    return found.select(CUSTOMER, CLUSTER)


def _one_value(spark: SparkSession, metric: str, value: float) -> DataFrame:
    row = spark.createDataFrame([(metric, value)], "metric STRING, silhouette DOUBLE")
    return _rounded(row, "silhouette")


def silhouette_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, over all customers: their scores take at most 125 different values."""
    scores = store(_scores(spark, sf_dir), "scores")
    assigned = clustering.assign_nearest(scores, SCORES, SCORE_CENTRES)
    return _one_value(spark, EUCLIDEAN, silhouette(assigned, SCORES))


def silhouette_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, over all pairs of customers, in several blocks."""
    scaled = clustering.scaled_table(_metrics(spark, sf_dir), RFM_METRICS)
    assigned = clustering.assign_nearest(scaled, RFM_METRICS, METRIC_CENTRES)
    return _one_value(spark, EUCLIDEAN, silhouette(assigned, RFM_METRICS, block_points=256))


def silhouette_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = clustering.scaled_table(_metrics(spark, sf_dir), RFM_METRICS)
    assigned = clustering.assign_nearest(scaled, RFM_METRICS, METRIC_CENTRES)
    value = silhouette(assigned, RFM_METRICS, metric=SQUARED_EUCLIDEAN)
    return _one_value(spark, SQUARED_EUCLIDEAN, value)


def _sweep(df: DataFrame) -> DataFrame:
    return _rounded(_rounded(df, "silhouette"), "inertia", digits=6)


def auto_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(clustering.auto_k(_metrics(spark, sf_dir)))


def auto_k_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep on scores, with the exact Euclidean silhouette."""
    scores = store(_scores(spark, sf_dir), "scores")
    return _sweep(clustering.auto_k(scores, SCORES, MINMAX_SCALER))


def best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = store(_scores(spark, sf_dir), "scores")
    return _rounded(clustering.best_k(clustering.auto_k(scores, SCORES, MINMAX_SCALER)), "silhouette")


def segment_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Algorithm, scaler and the range of k come from stored settings."""
    given = {
        "default_scaler": MINMAX_SCALER,
        "segmentation_default_algorithm": "Hierarchical (Agglomerative)",
        "auto_k": {"k_min": 5, "k_max": 3, "unknown": 1},
        "unknown": True,
    }
    scores = store(_scores(spark, sf_dir), "scores")
    found = segment(scores, features=SCORES, settings=Settings.from_dict(given))
    return found.select(CUSTOMER, CLUSTER)


def segment_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment with their metrics, as another tool would read them."""
    folder = fresh_path(spark, "results")
    whole_cents = _metrics(spark, sf_dir).withColumn("monetary", F.col("monetary").cast("bigint"))
    results.store_result(whole_cents, folder, "orders", "rfm")
    metrics = results.stored_result(spark, folder, "orders", "rfm")
    path = f"{folder}/segment"
    results.export_segment(t.segments(spark, sf_dir), metrics, CHOSEN_SEGMENT, path)
    return delimited.scan_delimited(spark, path, ",")


QUERIES = {
    "csv_scan": csv_scan,
    "csv_scan_quoted": csv_scan_quoted,
    "detect_separator": detect_separator,
    "map_columns": map_columns,
    "amount_qty_price": amount_qty_price,
    "parquet_scan": parquet_scan,
    "csv_export": csv_export,
    "export_manifest": export_manifest,
    "dataset_profile": dataset_profile,
    "coerce": coerce,
    "clean": clean,
    "date_format_vote": date_format_vote,
    "clean_light": clean_light,
    "date_range_stored": date_range_stored,
    "date_range": date_range,
    "date_range_full_day": date_range_full_day,
    "segments_placeholder": segments_placeholder,
    "attach_segments": attach_segments,
    "dedup_segments": dedup_segments,
    "segments_distinct": segments_distinct,
    "segment_customers": segment_customers,
    "recommendations": recommendations,
    "rfm_incremental": rfm_incremental,
    "rfm": compute_rfm,
    "rfm_events": rfm_events,
    "kpi": kpi,
    "kpi_range": kpi_range,
    "trend_day": trend_day,
    "trend_week": trend_week,
    "trend_month": trend_month,
    "trend_month_sketch": trend_month_sketch,
    "kpi_sketch": kpi_sketch,
    "segment_trend": segment_trend,
    "segment_share": segment_share,
    "segment_comparison": segment_comparison,
    "segment_comparison_order": segment_comparison_order,
    "report_summary": report_summary,
    "report_insights": report_insights,
    "month_segment_matrix": month_segment_matrix,
    "month_segment_wide": month_segment_wide,
    "segment_growth": segment_growth,
    "segment_growth_nofill": segment_growth_nofill,
    "growth_rate": growth_rate,
    "growth_events": growth_events,
    "growth_extremes": growth_extremes,
    "growth_direction": growth_direction,
    "rfm_ranks": rfm_ranks,
    "rfm_scores": rfm_scores,
    "rfm_weighted": rfm_weighted,
    "rfm_segments": rfm_segments,
    "rfm_segments_rules": rfm_segments_rules,
    "label_counts": label_counts,
    "features_standard": features_standard,
    "features_minmax": features_minmax,
    "kmeans_assign": kmeans_assign,
    "kmeans_segments": kmeans_segments,
    "hierarchical": hierarchical,
    "dbscan": dbscan_segments,
    "dbscan_six": dbscan_six,
    "hierarchical_single": hierarchical_single,
    "silhouette": silhouette_euclidean,
    "silhouette_blocks": silhouette_blocks,
    "silhouette_squared": silhouette_squared,
    "auto_k": auto_k,
    "auto_k_scores": auto_k_scores,
    "best_k": best_k,
    "segment_settings": segment_settings,
    "segment_export": segment_export,
}
