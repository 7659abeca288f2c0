"""Stored tables that are replaced in one step.

A table is a folder with a data folder per version, and an empty marker per published version
whose name holds a number and the data folder. A version is written whole before its marker is
created, which the file system does at once or not at all; readers take the highest number. A
write that fails leaves no marker, so the version before stays in force. Numbers are taken by
creating a file that must not exist. Of two writers that read the same version, the second finds
the number taken: `publish` then takes the next one, or fails if the new version was derived from
the one replaced. A number taken long ago by a writer that died is passed over.

A plain Parquet folder without markers is read as it is; publishing over it begins with 1.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from patronmap.storage import delete_folder

MARKERS = "_published"
KEPT = 2  # published versions whose data stays, for readers that are not done
STALE_SECONDS = 120  # a number taken so long ago and not marked belongs to a writer that died


class Outdated(RuntimeError):
    """Another writer published while a version was made from the one before."""


@dataclass(frozen=True)
class Version:
    number: int
    path: str


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str) -> list[Version]:
    """Published versions, the oldest first."""
    files, to_path = _file_system(spark, path)
    markers = to_path(f"{path}/{MARKERS}")
    if not files.exists(markers):
        return []
    names = [status.getPath().getName() for status in files.listStatus(markers)]
    split = (name.split("-", 1) for name in names if "-" in name)
    return sorted((Version(int(n), f"{path}/{folder}") for n, folder in split), key=lambda v: v.number)


def current(spark: SparkSession, path: str) -> Version | None:
    found = versions(spark, path)
    return found[-1] if found else None


def publish(
    spark: SparkSession,
    path: str,
    write: Callable[[str], None],
    after: Version | None = None,
    derived: bool = False,
    note: str = "",
) -> Version:
    """Let `write` make a version in the folder it is given, then put it in force.

    With `derived` the version was made from `after` and must follow it directly. `note` ends
    the name of the folder.
    """
    folder = f"data-{uuid.uuid4().hex}{note}"
    try:
        write(f"{path}/{folder}")
        made = _mark(spark, path, folder, after, derived)
    except BaseException:
        delete_folder(spark, f"{path}/{folder}")
        raise
    for old in versions(spark, path)[:-KEPT]:
        if old.number < made.number:
            delete_folder(spark, old.path)
            delete_folder(spark, f"{path}/{MARKERS}/{old.number:012d}-{old.path.rsplit('/', 1)[-1]}")
            delete_folder(spark, f"{path}/{MARKERS}/{old.number:012d}")
    return made


def _mark(spark: SparkSession, path: str, folder: str, after: Version | None, derived: bool) -> Version:
    """Take the next number by a file that only one writer can create, then mark the folder with it."""
    files, to_path = _file_system(spark, path)
    skipped = 0
    while True:
        last = current(spark, path)
        before = last.number if last else 0
        if derived and before != (after.number if after else 0):
            raise Outdated(f"{path} has a version made by another writer")
        number = before + 1 + skipped
        lock = to_path(f"{path}/{MARKERS}/{number:012d}")
        if files.createNewFile(lock):
            files.create(to_path(f"{path}/{MARKERS}/{number:012d}-{folder}"), False).close()
            return Version(number, f"{path}/{folder}")
        taken = files.getFileStatus(lock).getModificationTime() / 1000
        if (current(spark, path) or Version(0, "")).number < number:
            # Its writer is about to mark it, or died on the way.
            if time.time() - taken > STALE_SECONDS:
                skipped += 1
            else:
                time.sleep(0.1)


def write_version(df: DataFrame, path: str, after: Version | None = None, derived: bool = False) -> Version:
    """Publish `df` as Parquet."""
    return publish(df.sparkSession, path, lambda folder: df.write.parquet(folder), after, derived)


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The version in force, a plain Parquet folder, or None if there is neither; a damaged file is an error."""
    version = current(spark, path)
    try:
        return spark.read.parquet(version.path if version else path)
    except AnalysisException as error:
        if version is None and error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
