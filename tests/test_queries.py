"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


def test_entry(spark):
    flagship = contract.entry(spark)
    assert flagship.columns == ["Segment_label", "customers"] and flagship.count() > 0


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    frame = contract.queries()[name](spark, SF_DIR)
    assert differences(frame, tables, contract.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["kmeans_segments", "hierarchical"])
def test_every_customer_has_a_cluster(spark, name):
    frame = contract.queries()[name](spark, SF_DIR)
    customers = contract.queries()["rfm"](spark, SF_DIR).count()
    assert frame.count() == customers
    assert {r.cluster for r in frame.select("cluster").distinct().collect()} == {0, 1, 2, 3}
