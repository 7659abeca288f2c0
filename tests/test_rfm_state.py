from __future__ import annotations

import re

import pytest

from patronmap.operators.rfm import compute_rfm
from patronmap.operators.rfm_state import RfmState, partial_state
from patronmap.sources import versions
from patronmap.storage import fresh_path

SNAPSHOT = "2023-06-01"
ROWS = [(i % 7 if i % 10 else None, f"2023-0{1 + i % 5}-{1 + i % 27:02d} 0{i % 9}:30:00", float(i) if i % 4 else None) for i in range(200)]
ROWS += [(100, None, 1.0), (101, "2023-01-01", None), (5, "2023-05-31 23:59:59", -3.0)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def state(spark):
    return RfmState(spark, fresh_path(spark, "state"), buckets=5)


def test_many_updates_equal_the_full_computation(tx, state):
    for start in range(0, len(ROWS), 41):
        state.update(tx_all(tx, ROWS[start : start + 41]))
        assert rows(state.rfm(SNAPSHOT)) == rows(compute_rfm(tx_all(tx, ROWS[: start + 41]), SNAPSHOT))


def tx_all(tx, given):
    """Rows with dates, missing ones kept."""
    from pyspark.sql import functions as F

    frame = tx([(0, "2023-01-01", 0.0)]).sparkSession.createDataFrame(given, "customer_id BIGINT, d STRING, amount DOUBLE")
    return frame.select("customer_id", F.to_timestamp("d").alias("transaction_date"), "amount")


def test_the_state_is_not_shuffled(spark, tx, state):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state.update(tx_all(tx, ROWS))
        plan = state.merged(partial_state(tx_all(tx, ROWS[:20])), versions.current(spark, state.path))
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = lambda line: len(re.match(r"[\s:+\-|]*", line)[0])
    above, limit = [], depth(lines[at])
    for line in reversed(lines[:at]):  # the operators between the scan and the root
        if depth(line) < limit:
            above.append(line)
            limit = depth(line)
    assert any("Join" in line for line in above) and not any("Exchange" in line for line in above)
    assert any("Exchange" in line for line in lines)


def test_repeated_numbers_are_ignored(tx, state):
    state.update(tx_all(tx, ROWS[:50]), 3)
    once = rows(state.rfm(SNAPSHOT))
    state.update(tx_all(tx, ROWS[:50]), 3)
    state.update(tx_all(tx, ROWS[50:60]), 2)
    assert rows(state.rfm(SNAPSHOT)) == once
    state.update(tx_all(tx, ROWS[50:]), 4)
    assert rows(state.rfm(SNAPSHOT)) == rows(compute_rfm(tx_all(tx, ROWS), SNAPSHOT))


def test_empty_updates_and_hot_customers(spark, tx, state):
    assert state.update(tx_all(tx, [])) is None
    with pytest.raises(ValueError):
        state.rfm(SNAPSHOT)
    hot = [(1, "2023-01-01", 1.0)] * 500 + [(2, "2023-01-02", 2.0)]
    state.update(tx_all(tx, hot))
    state.update(tx_all(tx, []))
    assert rows(state.rfm(SNAPSHOT)) == [(1, 151, 500, 500.0), (2, 150, 1, 2.0)]


def test_a_stream_keeps_the_state(spark, tx, state, tmp_path):
    given = tx_all(tx, ROWS)
    for i, part in enumerate(given.randomSplit([1.0, 1.0, 1.0], seed=1)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: state.update(batch, number) and None)
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert rows(state.rfm(SNAPSHOT)) == rows(compute_rfm(given, SNAPSHOT))
