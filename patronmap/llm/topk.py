"""Exact top-k inner products by block-at-a-time pruning.

Components are terms with whole-number weights. Vectors are range-sorted by their strongest
terms and cut into blocks; a block keeps a forward index (its vectors as a matrix) and the
largest and smallest weight of every term in it. For a query the sum over terms of the larger
of query weight times either bound is at least the score of any vector in the block. A task
takes a group of queries and a shard of blocks: every query visits the blocks in falling order
of that sum and scores them whole, until the sum is below its kth score so far; sums equal to
it are still visited, for ties. The best of the shards are merged per query.

All queries meet all shards, as rows of matrices joined on a shard number; no pair of vectors
becomes a row, except the k best of a query in a shard. Scores are exact: matrices are
multiplied as doubles where no sum can reach 2^53, as Python integers otherwise.

Defined cases: a vector that is null, or has a null or non-finite component, or a null id,
takes no part; vectors of different lengths are filled up with zeros; of rows with one id each is
a candidate, and each a query if the id is one, whose own row alone is left out; ties go to the
smaller id; fewer candidates than k give all of them;
scores beyond 64 bits stop at the largest or smallest long; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronmap.llm.common import Batches, inputs, scoped
from patronmap.storage import store

SCALE = 64.0
BLOCK = 256  # vectors whose terms share one bound
SHARD = 16384  # vectors in a task's shard, at most
GROUP = 1024  # queries in a task's group, at most
EXACT = float(1 << 53)
LONGS = (-(1 << 63), (1 << 63) - 1)


def weights(vector: np.ndarray, scale: float = SCALE) -> np.ndarray:
    return np.floor(scale * vector)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector, number): only finite vectors; the number tells rows apart."""
    rows = inputs(df, vec_id=id_col, vector=vector_col)
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.forall("vector", lambda x: F.coalesce(finite(x), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & whole)
    return rows.withColumn("number", F.monotonically_increasing_id())


def _matrices(rows: DataFrame, size: int, scale: float, name: str, parts: int) -> DataFrame:
    """Rows of at most `size` vectors: ids, numbers, weights as doubles, dim.

    Vectors are ordered by the places and signs of their strongest terms, so that vectors
    that point the same way share blocks.
    """
    strongest = F.sort_array(
        F.transform("vector", lambda x, i: F.struct(F.abs(x).alias("a"), i.alias("i"), (x > 0).alias("up"))), asc=False
    )
    key = F.transform(F.slice(strongest, 1, 2), lambda x: F.struct(x["i"].alias("i"), x["up"].alias("up")))
    ordered = rows.withColumn("key", key).repartitionByRange(parts, "key", "vec_id", "number").sortWithinPartitions("key", "vec_id", "number")

    def run(batches: Batches) -> Batches:
        ids: list[int] = []
        numbers: list[int] = []
        vectors: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            dim = max(map(len, vectors))
            matrix = np.zeros((len(vectors), dim))
            for i, v in enumerate(vectors):
                matrix[i, : len(v)] = weights(v, scale)
            # The bytes are kept as rows of one text of doubles; most compress well.
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.list_(pa.int64())) for x in (ids, numbers)), pa.array([matrix.tobytes()], pa.binary()), pa.array([dim], pa.int32())],
                names=["ids", "numbers", "matrix", "dim"],
            )

        for batch in batches:
            for one, number, vector in zip(batch.column("vec_id").to_pylist(), batch.column("number").to_pylist(), batch.column("vector")):
                ids.append(one)
                numbers.append(number)
                vectors.append(vector.values.to_numpy(zero_copy_only=False))
                if len(ids) == size:
                    yield out()
                    ids, numbers, vectors = [], [], []
        if ids:
            yield out()

    made = ordered.select("vec_id", "number", "vector").mapInArrow(run, "ids array<bigint>, numbers array<bigint>, matrix binary, dim int")
    return store(made.withColumn("at", F.monotonically_increasing_id()), name)


def product(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """rows @ columns.T in whole numbers."""
    most = np.abs(rows).max(initial=0) * np.abs(columns).max(initial=0) * max(1, rows.shape[1])
    if most < EXACT:
        return (rows @ columns.T).astype(np.int64)
    exact = rows.astype(object)
    to_int = np.vectorize(int, otypes=[object])
    found = np.dot(to_int(exact), to_int(columns.astype(object)).T)
    return np.vectorize(lambda x: min(max(x, LONGS[0]), LONGS[1]), otypes=[np.int64])(found)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.nonzero(scores >= kth)[0]
        scores, ids = scores[at], ids[at]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _pad(matrix: np.ndarray, dim: int) -> np.ndarray:
    return matrix if matrix.shape[1] == dim else np.pad(matrix, ((0, 0), (0, dim - matrix.shape[1])))


def search(
    queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK
) -> tuple[list[tuple], int]:
    """(scores, ids) of the best in a shard per query, and how many blocks were scored: see the module."""
    dim = max(queries.shape[1], vectors.shape[1])
    queries, vectors = _pad(queries, dim), _pad(vectors, dim)
    starts = list(range(0, len(vectors), block))
    blocks = [vectors[s : s + block] for s in starts]
    block_ids = [ids[s : s + block] for s in starts]
    block_rows = [rows[s : s + block] for s in starts]
    high = np.stack([b.max(axis=0) for b in blocks])
    low = np.stack([b.min(axis=0) for b in blocks])
    # Rounded outwards where doubles cannot hold the sums.
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    bounds += np.abs(bounds) * 1e-9 * (np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * dim >= EXACT)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries]
    floor = np.full(len(queries), -np.inf)
    active = np.arange(len(queries))
    scored = 0
    for turn in range(len(blocks)):
        at = order[active, turn]
        open_ = bounds[active, at] >= floor[active]
        active, at = active[open_], at[open_]
        if not len(active):
            break
        for b in np.unique(at):
            these = active[at == b]
            scores = product(queries[these], blocks[b])
            scored += len(these)
            for q, found in zip(these, scores):
                others = block_rows[b] != query_rows[q]
                s = np.concatenate([best[q][0], found[others]])
                i = np.concatenate([best[q][1], block_ids[b][others]])
                best[q] = _best(s, i, k)
                if len(best[q][0]) == k:
                    floor[q] = best[q][0][-1]
    return best, scored


@scoped("nearest")
def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = SCALE,
    group: int = GROUP,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where `is_query` (of the column vec_id) holds."""
    rows = store(usable(vectors, id_col, vector_col), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query(F.col("vec_id")))).first()
    shards = _matrices(rows, shard, scale, "shards", max(1, -(-n // shard)))
    groups = _matrices(rows.where(is_query(F.col("vec_id"))), group, scale, "groups", max(1, -(-n_queries // group)))
    # Every group goes to every shard: matrices under a shard's number, in one array of numbers.
    places = shards.agg(F.collect_list("at").alias("places"))
    sent = groups.join(F.broadcast(places)).select(
        F.col("ids").alias("query_ids"), F.col("numbers").alias("query_rows"), F.col("matrix").alias("queries"),
        F.col("dim").alias("query_dim"), F.col("at").alias("group"), F.explode("places").alias("at"),
    )
    tasks = max(1, -(-n // shard) * -(-n_queries // group))
    both = sent.join(shards, "at").repartition(tasks, "at", "group")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row] for c in batch.schema.names}
                queries = np.frombuffer(at["queries"].as_buffer()).reshape(-1, at["query_dim"].as_py())
                matrix = np.frombuffer(at["matrix"].as_buffer()).reshape(-1, at["dim"].as_py())
                ids, rows, query_ids, query_rows = (at[c].values.to_numpy() for c in ("ids", "numbers", "query_ids", "query_rows"))
                found, _ = search(queries, query_rows, matrix, ids, rows, k, block)
                counts = [len(s) for s, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(query_rows, counts)),
                        pa.array(np.repeat(query_ids, counts)),
                        pa.array(np.concatenate([i for _, i in found])),
                        pa.array(np.concatenate([s for s, _ in found])),
                    ],
                    names=["query_row", "query_id", "vec_id", "score"],
                )

    found = both.select("query_ids", "query_rows", "queries", "query_dim", "ids", "numbers", "matrix", "dim").mapInArrow(
        run, "query_row bigint, query_id bigint, vec_id bigint, score bigint"
    )
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
