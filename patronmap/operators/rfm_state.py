"""Recency, frequency and monetary value kept up to date from new transactions.

A state holds a row per customer: last transaction, number of dated rows, sum of amounts. It is
stored in buckets by customer. New transactions are combined per customer and dealt to the same
buckets; the state is read bucket by bucket, joined where it lies and written to the same buckets
again, so it is never shuffled, and only the new rows move. Every version is published whole (see
`sources.versions`): a failed update leaves the one before, and of two updates at the same time
one is refused.

Updates may carry rising numbers, such as those of a stream's batches; one that does not
exceed the last number is ignored, so an update may be repeated after a failure.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronmap.functions.numbers import known_number
from patronmap.operators.cleaning import drop_missing
from patronmap.operators.rfm import recency_days
from patronmap.schema import AMOUNT, CUSTOMER, DATE, FREQUENCY, MONETARY, RECENCY
from patronmap.sources.versions import Version, current, publish

LAST, ROWS, TOTAL = "last_date", "dated_rows", "total"
BUCKETS = 64


def partial_state(transactions: DataFrame) -> DataFrame:
    """What transactions add to a state, a row per customer; null customers have none."""
    return drop_missing(transactions, CUSTOMER).groupBy(CUSTOMER).agg(
        F.max(F.col(DATE).cast("timestamp")).alias(LAST),
        F.count(DATE).alias(ROWS),
        F.sum(known_number(transactions, AMOUNT)).alias(TOTAL),
    )


@contextmanager
def _name(spark: SparkSession) -> Iterator[str]:
    """A table name for the time in which a frame is made; the files are not the catalog's."""
    name = f"rfm_state_{uuid.uuid4().hex}"
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


class RfmState:
    """The state stored at `path`; `buckets` counts when it is first written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.first_buckets = spark, path, buckets

    @staticmethod
    def _notes(version: Version | None) -> tuple[int | None, int | None]:
        """(buckets, last update) of a version, which end its folder's name."""
        if version is None:
            return None, None
        buckets, update = version.path.rsplit("-", 2)[1:]
        return int(buckets), int(update) if update != "none" else None

    def read(self, version: Version | None = None) -> DataFrame | None:
        """The state as a bucketed table, or None before the first update."""
        version = version or current(self.spark, self.path)
        if version is None:
            return None
        buckets, _ = self._notes(version)
        fields = self.spark.read.parquet(version.path).schema
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
        with _name(self.spark) as name:
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({CUSTOMER}) SORTED BY ({CUSTOMER}) "
                f"INTO {buckets} BUCKETS LOCATION '{version.path}'"
            )
            return self.spark.table(name)

    def merged(self, new: DataFrame, version: Version | None) -> DataFrame:
        """The state with partial states put in; only these move."""
        buckets, _ = self._notes(version)
        dealt = new.repartition(buckets or self.first_buckets, CUSTOMER)
        if version is None:
            return dealt
        old, new = self.read(version).alias("old"), dealt.alias("new")
        added = F.coalesce(F.col(f"old.{TOTAL}") + F.col(f"new.{TOTAL}"), f"old.{TOTAL}", f"new.{TOTAL}")
        kind = old.schema[TOTAL].dataType
        return old.join(new, CUSTOMER, "full").select(
            CUSTOMER,
            F.greatest(f"old.{LAST}", f"new.{LAST}").alias(LAST),
            (F.coalesce(f"old.{ROWS}", F.lit(0)) + F.coalesce(f"new.{ROWS}", F.lit(0))).alias(ROWS),
            added.cast(kind).alias(TOTAL),
        )

    def update(self, transactions: DataFrame, number: int | None = None) -> Version | None:
        """Put transactions in; returns the version in force. Without any, nothing is written."""
        before = current(self.spark, self.path)
        buckets, last = self._notes(before)
        if number is not None and last is not None and number <= last:
            return before
        new = partial_state(transactions)
        if new.isEmpty():
            return before
        state = self.merged(new, before)
        buckets = buckets or self.first_buckets

        def write(folder: str) -> None:
            with _name(self.spark) as name:
                writer = state.write.format("parquet").bucketBy(buckets, CUSTOMER).sortBy(CUSTOMER)
                writer.option("path", folder).saveAsTable(name)

        known = number if number is not None else last
        note = f"-{buckets}-{'none' if known is None else known}"
        return publish(self.spark, self.path, write, before, derived=True, note=note)

    def rfm(self, snapshot: str) -> DataFrame:
        """The metrics at `snapshot`, as `compute_rfm` gives them for all transactions put in."""
        state = self.read()
        if state is None:
            raise ValueError(f"no transactions were put into {self.path}")
        return state.select(
            CUSTOMER,
            recency_days(F.col(LAST), snapshot).alias(RECENCY),
            F.col(ROWS).alias(FREQUENCY),
            F.coalesce(F.col(TOTAL).cast("double"), F.lit(0.0)).alias(MONETARY),
        )
