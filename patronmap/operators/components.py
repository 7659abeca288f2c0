"""Connected components of an undirected graph by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronmap.operators.segments import BROADCAST_ROWS
from patronmap.storage import scratch, store


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the label is the smallest node of the component.

    `nodes` has the column node, `edges` the columns src and dst, each edge once. Every
    round passes the label of a node's label along the edges, both to the neighbour and
    to the neighbour's label, so rounds grow with the logarithm of a path, not with its
    length. Each round is written to the shared folder and deleted after the next one.
    Many nodes are joined by sorting, so that the driver never holds them for a broadcast.
    """
    spark = nodes.sparkSession
    with scratch(spark) as scope:
        both = store(
            edges.select("src", "dst").unionAll(edges.select(F.col("dst"), F.col("src"))), "edges"
        )
        labels = nodes.select("node", F.col("node").alias("label"))
        many = nodes.count() > BROADCAST_ROWS
        before = None
        while True:
            labels = store(_round(labels, both, many), "labels")
            if before is not None:
                scope.drop(before)
            before = scope.last()
            if labels.where(F.col("label") != F.col("old")).isEmpty():
                scope.release(before)
                return labels.drop("old")


def _round(labels: DataFrame, both: DataFrame, many: bool) -> DataFrame:
    def side(df: DataFrame) -> DataFrame:
        return df.hint("merge") if many else df

    onward = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
    # Many nodes come to share a label; adaptive execution splits such a partition.
    state = labels.select("node", "label").join(side(onward), "label")
    offered = (
        both.join(side(state), both.dst == state.node)
        .groupBy("src")
        .agg(F.min("far").alias("offer"))
        .withColumnRenamed("src", "node")
    )
    best = F.least("label", "far", "offer").alias("best")
    # The best label goes to the node, and to the node that gave it its old label.
    to_both = F.array(
        F.struct("node", "best", F.col("label").alias("old")),
        F.struct(F.col("label").alias("node"), "best", F.lit(None).alias("old")),
    )
    return (
        state.join(side(offered), "node", "left")
        .select("node", "label", best)
        .select(F.inline(to_both))
        .groupBy("node")
        .agg(F.min("best").alias("label"), F.max("old").alias("old"))
    )
