from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


TX = "customer_id BIGINT, transaction_date STRING, amount DOUBLE"


@pytest.fixture
def tx(spark):
    """Transactions from tuples, cleaned lightly."""
    from patronmap.operators.cleaning import clean_light

    return lambda rows, schema=TX: clean_light(spark.createDataFrame(rows, schema))


def as_dict(df, *keys):
    """Rows by key; one key column gives plain keys."""
    out = {}
    for row in df.collect():
        key = row[keys[0]] if len(keys) == 1 else tuple(row[k] for k in keys)
        assert key not in out
        out[key] = row
    return out
