"""The date format of a text column, settled by all of its rows.

Every known value votes for each format that reads it, all formats in one pass. `13/01/2023`
votes for day-first alone, so a column of days and months is told apart as soon as one of its
values can be read one way only. The format that reads most values wins; of equal ones the first in
`CANDIDATES`, which holds month-first before day-first. ISO dates need no format and always count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronmap.functions.coerce import as_timestamp
from patronmap.operators.cleaning import coerce
from patronmap.schema import DATE

# Orders of day, month and year, signs between them, and times that may follow.
ORDERS = ("M{0}d{0}yyyy", "d{0}M{0}yyyy", "yyyy{0}M{0}d", "M{0}d{0}yy", "d{0}M{0}yy", "d{0}MMM{0}yyyy")
SIGNS = ("/", ".", "-", " ")
TIMES = "[ H:mm[:ss]]"
CANDIDATES = tuple(order.format(sign) + TIMES for order in ORDERS for sign in SIGNS)


def date_votes(df: DataFrame, column: str = DATE, candidates: Sequence[str] = CANDIDATES) -> DataFrame:
    """(format, preference, known, readable, first, last): a row per format, and one for ISO with a null format.

    `known` counts values that are neither null nor blank, `readable` those that the format or ISO
    reads.
    """
    text = F.trim(F.col(f"`{column}`").cast("string"))
    value = F.when(F.length(text) > 0, text)
    kinds = [None, *candidates]
    read = [as_timestamp(F.col("value"), T.StringType(), [] if f is None else [f]) for f in kinds]
    # Equal values, such as the rows of one day, are read once.
    counted = df.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    wide = counted.select("n", *(moment.alias(f"f{i}") for i, moment in enumerate(read)))
    sums = [F.coalesce(F.sum("n"), F.lit(0)).alias("known")]
    for i in range(len(read)):
        seen = F.when(F.col(f"f{i}").isNotNull(), F.col("n")).otherwise(0)
        sums += [F.coalesce(F.sum(seen), F.lit(0)).alias(f"n{i}"), F.min(f"f{i}").alias(f"a{i}"), F.max(f"f{i}").alias(f"z{i}")]
    rows = F.array(*(
        F.struct(
            F.lit(f).cast("string").alias("format"), F.lit(i).alias("preference"), F.col("known"),
            F.col(f"n{i}").alias("readable"), F.col(f"a{i}").alias("first"), F.col(f"z{i}").alias("last"),
        )
        for i, f in enumerate(kinds)
    ))
    return wide.agg(*sums).select(F.inline(rows))


def choose_format(votes: DataFrame) -> DataFrame:
    """The row of the format that reads most values; ISO alone if no format reads more than that."""
    return votes.orderBy(F.desc("readable"), "preference").limit(1)


def detect_date_format(df: DataFrame, column: str = DATE, candidates: Sequence[str] = CANDIDATES) -> str | None:
    """The column's format beside ISO, or None if it needs none."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return None
    return choose_format(date_votes(df, column, candidates)).first()["format"]


def coerce_column(df: DataFrame, candidates: Sequence[str] = CANDIDATES) -> DataFrame:
    """Like `coerce`, with the one format that the date column as a whole has."""
    found = detect_date_format(df, DATE, candidates)
    return coerce(df, [found] if found else [])
