import numpy as np
import pytest

from patronmap.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, score string, rank int"


def brute(rows, k):
    """Every pair of rows, in Python integers."""
    kept = []
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, [int(np.floor(64 * float(np.float32(x)))) for x in v]))
    out = []
    for n, (q, mine) in enumerate(kept):
        if q % 20:
            continue
        found = sorted((-sum(a * b for a, b in zip(mine, w)), i) for m, (i, w) in enumerate(kept) if m != n)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    found = topk.top_k(df, lambda i: i % 20 == 0, **options).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)


def test_equals_brute_force_in_small_blocks(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.standard_normal(8).round(1).tolist(), "x", 1) for i in range(300)]
    assert result(spark, rows, k=5, group=7, shard=64, block=8) == brute(rows, 5)


def test_ties_nulls_lengths_and_repeated_rows(spark):
    one = [1.0, -0.5, 0.25]
    rows = [(i, one, None, None) for i in range(50)]
    rows += [(100, None, "a", 1), (101, [1.0, None, 2.0], "a", 1), (102, [float("nan")], "a", 1), (103, [float("inf")], "a", 1)]
    rows += [(None, one, "a", 1), (104, [], "a", 1), (105, [2.0], "a", 1), (0, one, None, None), (1, one, None, None)]
    assert result(spark, rows, k=4, shard=16, group=2, block=4) == brute(rows, 4)


def test_every_row_of_a_repeated_id_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0], "x", 1), (1, [5.0, 0.0], "x", 1), (1, [2.0, 0.0], "x", 1), (0, [3.0, 0.0], "x", 1)]
    found = result(spark, rows, k=2)
    assert found == brute(rows, 2)
    assert (0, 1, 1, 64 * 320) in found and (0, 2, 0, 64 * 192) in found


def test_fewer_candidates_and_empty_table(spark):
    rows = [(0, [1.0], None, None), (1, [2.0], None, None)]
    assert result(spark, rows, k=20) == [(0, 1, 1, 64 * 128)]
    assert result(spark, [], k=20) == []
    assert result(spark, [(1, [2.0], None, None)], k=20) == []


def test_products_beyond_doubles_are_exact():
    big = np.array([[float(1 << 40), 3.0]])
    assert topk.product(big, np.array([[float(1 << 20), 5.0]])).tolist() == [[(1 << 60) + 15]]
    assert topk.product(big, np.array([[float(1 << 40), 5.0]])).tolist() == [[(1 << 63) - 1]]


def test_blocks_below_the_kth_score_are_skipped():
    near = np.tile([[10.0, 0.0]], (64, 1))
    far = np.tile([[-10.0, 0.0]], (640, 1))
    vectors, ids = np.concatenate([far, near]), np.arange(704)
    found, scored = topk.search(np.array([[5.0, 1.0]]), np.array([-1]), vectors, ids, ids, k=3, block=64)
    assert found[0][1].tolist() == [640, 641, 642]
    assert scored == 1


@pytest.mark.parametrize("k", [1, 3])
def test_best_takes_smaller_ids(k):
    scores, ids = topk._best(np.array([5, 7, 7, 1]), np.array([4, 9, 2, 0]), k)
    assert list(zip(scores, ids)) == [(7, 2), (7, 9), (5, 4)][:k]
