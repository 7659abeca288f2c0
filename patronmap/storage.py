"""Cutting lineage through the shared folder named by `spark.checkpoint.dir`."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Folders written inside the innermost open scope.
_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)


# Used only by a local master, whose tasks all run in one place.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach; a local master without a setting has its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(folder or LOCAL_FOLDER)
    return folder or context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    base = shared_folder(spark).rstrip("/")
    return f"{base}/patronmap/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A scope whose stored tables are deleted when it ends, whether it succeeds or fails.

    What outlives the scope is handed over with `keep` or `release`; scopes inside others
    hand their kept tables to them. Outside any scope tables stay until the caller deletes them.
    """
    scope = Scratch(spark, _written.get())
    token = _written.set(scope.paths)
    try:
        yield scope
    finally:
        _written.reset(token)
        for path in scope.paths:
            delete_folder(spark, path)


class Scratch:
    def __init__(self, spark: SparkSession, outer: list[str] | None) -> None:
        self.spark, self.outer, self.paths = spark, outer, []

    def last(self) -> str:
        """Path of the table stored last."""
        return self.paths[-1]

    def drop(self, path: str) -> None:
        """Delete a table of this scope that is no longer needed."""
        self.paths.remove(path)
        delete_folder(self.spark, path)

    def release(self, path: str) -> None:
        """Let a table of this scope outlive it."""
        self.paths.remove(path)
        if self.outer is not None:
            self.outer.append(path)

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Store `df` beyond the scope."""
        kept = store(df, name)
        self.release(self.last())
        return kept


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df: DataFrame, name: str = "frame") -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Later passes read the columns they need from files instead of recomputing the
    lineage, and survive the loss of executors.
    """
    path = fresh_path(df.sparkSession, name)
    if (written := _written.get()) is not None:
        written.append(path)
    return _write(df, path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; unlike `store` it keeps partitions and the order in them.

    Spark deletes it with the frame if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
