from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from patronmap.sources import mapping, results, versions
from patronmap.storage import fresh_path


def test_the_last_published_version_is_read(spark):
    path = fresh_path(spark, "versions")
    assert versions.read_version(spark, path) is None and versions.current(spark, path) is None
    for n in (1, 2, 3, 4):
        assert versions.write_version(spark.range(n), path).number == n
        assert versions.read_version(spark, path).count() == n
    assert [v.number for v in versions.versions(spark, path)] == [3, 4]


def test_a_write_that_fails_midway_leaves_the_old_result(spark):
    path = fresh_path(spark, "results")
    results.store_result(spark.range(5), path, "d", "rfm")
    broken = spark.range(1000).repartition(4).select(F.when(F.col("id") == 777, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        results.store_result(broken, path, "d", "rfm")
    assert results.stored_result(spark, path, "d", "rfm").count() == 5
    results.store_result(spark.range(7), path, "d", "rfm")
    assert results.stored_result(spark, path, "d", "rfm").count() == 7


def test_a_reader_keeps_the_version_it_opened(spark):
    path = fresh_path(spark, "versions")
    versions.write_version(spark.range(3), path)
    opened = versions.read_version(spark, path)
    versions.write_version(spark.range(9), path)
    assert opened.count() == 3


def test_a_plain_folder_is_read_and_replaced(spark):
    path = fresh_path(spark, "plain")
    spark.range(4).write.parquet(path)
    assert versions.read_version(spark, path).count() == 4
    versions.write_version(spark.range(2), path)
    assert versions.read_version(spark, path).count() == 2


def test_a_version_made_from_an_older_one_is_refused(spark):
    path = fresh_path(spark, "versions")
    first = versions.write_version(spark.range(1), path)
    versions.write_version(spark.range(2), path)
    with pytest.raises(versions.Outdated):
        versions.write_version(spark.range(3), path, first, derived=True)
    assert versions.read_version(spark, path).count() == 2


def test_a_dataset_registered_twice_has_one_entry(spark, tx):
    catalog = fresh_path(spark, "catalog")
    names = mapping.ColumnMapping("c", "d", "a")
    results.register_dataset(tx([(1, "2023-01-01", 2.0)]), "one", "first.csv", names, catalog)
    results.register_dataset(tx([(2, "2023-01-01", 2.0)]), "two", "second.csv", names, catalog)
    results.register_dataset(tx([(1, "2023-01-01", 2.0)] * 3), "one", "again.csv", names, catalog)
    found = {r.id: (r.original_name, r.rows) for r in results.read_catalog(spark, catalog).collect()}
    assert found == {"one": ("again.csv", 3), "two": ("second.csv", 1)}


def test_a_number_taken_by_a_writer_that_died_is_passed_over(spark, monkeypatch):
    path = fresh_path(spark, "versions")
    versions.write_version(spark.range(1), path)
    files, to_path = versions._file_system(spark, path)
    assert files.createNewFile(to_path(f"{path}/{versions.MARKERS}/{2:012d}"))
    monkeypatch.setattr(versions, "STALE_SECONDS", -1)
    assert versions.write_version(spark.range(2), path, versions.current(spark, path), derived=True).number == 3
    assert versions.read_version(spark, path).count() == 2
