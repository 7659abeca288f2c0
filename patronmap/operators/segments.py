"""Segment tables: one segment per customer, joined to transactions or texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronmap.schema import CLUSTER, CUSTOMER, LABEL, SEGMENT_COLUMNS

# Fixed value: shown where customers have not been segmented.
NO_SEGMENT = "—"

# A table is sent to every executor only below both of these measured sizes.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024


def dedup_segments(segments: DataFrame) -> DataFrame:
    """One row per customer with whichever segment columns exist.

    Of several rows the first by (Segment_label, cluster) is kept, known values first: a
    minimum, so a customer with very many rows is reduced before the shuffle.

    The customer is grouped inside a struct. A join on it then exchanges this side anew,
    and adaptive execution can split the partition of a customer that holds a large
    share of the other side, which it does only where both sides are exchanged by the
    join itself.
    """
    present = [c for c in (LABEL, CLUSTER) if c in segments.columns]
    who = F.struct(CUSTOMER).alias("_who")
    order = [x for c in present for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]
    first = F.min(F.struct(*order, F.lit(None))).alias("_first")
    ordered = [c for c in SEGMENT_COLUMNS if c in present]
    return (
        segments.groupBy(who)
        .agg(first)
        .select(f"_who.{CUSTOMER}", *(F.col(f"_first.{c}").alias(c) for c in ordered))
    )


def placeholder_segments(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(NO_SEGMENT) for c in SEGMENT_COLUMNS})


def attach_segments(df: DataFrame, segments: DataFrame | None) -> DataFrame:
    """Segment columns for every row of `df`; customers without a segment keep nulls."""
    if segments is None:
        return placeholder_segments(df)
    return df.join(dedup_segments(segments), CUSTOMER, "left")


def distinct_segments(df: DataFrame, segment: str = LABEL) -> DataFrame:
    return df.select(segment).dropna().distinct()


def customers_of_segment(df: DataFrame, value: object, segment: str = LABEL) -> DataFrame:
    return df.where(F.col(segment) == F.lit(value))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast if the measured size of `df` allows it, else leave `df` alone."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    head = df.limit(BROADCAST_ROWS + 1)
    rows, total = head.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def recommend(df: DataFrame, texts: DataFrame, segment: str = LABEL) -> DataFrame:
    """Join texts by segment; the few segments make hot keys, so the text side is broadcast."""
    return df.join(broadcast_if_small(texts), segment, "left")
