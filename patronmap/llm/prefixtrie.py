"""Prefix trie of conversations by ternary search trees per range shard.

Turns are told apart by a digest of role and text and numbered by a dictionary; a conversation
becomes the array of its turns' numbers. Conversations are range-sorted by that array and their
id, so that all that share a prefix lie in neighbouring shards. A task builds a ternary search
tree over the different arrays of its shard, putting in the middle one first, then the middles
of both halves and so on, and walks the nodes from the last to the first made, without recursion,
to sum members, childless nodes and saved tokens.

The nodes on the paths to the first and the last array of a shard may go on in others; all others
are complete. Nodes of both paths of all shards are merged by the digest of their path: members
add up, a child that several shards hold counts once, and a merged node gives its own leaf and
saving to one of the paths that hold it, from where they are summed upwards per path and then
over the paths. Such nodes are two paths a shard, however many conversations share them.

Texts do not move: only digests and numbers do. Numbers of turns that make more than a
thousandth of all rows (at most 1,000) are broadcast, others joined. A conversation's numbers (16
bytes a turn) are held by one task. Ids of members that end at a node are hashed in order, as
texts of whole shards, one after another.

Defined cases: a null conv_id takes no part; null role or text is empty; a null turn comes first,
equal turns are ordered by digest; repeated rows are turns of their own; remainders are those
of SQL, with the sign of the id; an empty table gives no rows, not even the root.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronmap.llm.common import WORD, Batches, inputs
from patronmap.storage import scratch, store

SHARD_TURNS = 100_000  # turns of a shard's conversations, on average
HOT_SHARE = 1000  # a turn that makes more than 1 / HOT_SHARE of all rows is broadcast
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = b""  # the digest of the empty path


# Rebuilding


def encoded(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, ids, words): a conversation's turns in order, as numbers and counts of words."""
    rows = inputs(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    rows = store(rows, "turns")
    kinds = rows.groupBy("digest").agg(F.count("*").alias("n"), F.first("words").alias("words"))
    kinds = store(kinds.withColumn("id", F.monotonically_increasing_id()), "dictionary")
    total = rows.count()
    hot = kinds.where(F.col("n") * HOT_SHARE > total).select("digest", "id")
    rare = kinds.where(F.col("n") * HOT_SHARE <= total).select("digest", "id")
    known = rows.join(F.broadcast(hot), "digest")  # at most HOT_SHARE rows
    others = rows.join(F.broadcast(hot), "digest", "left_anti").join(rare, "digest")
    both = known.unionByName(others)
    order = F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "words")))
    found = both.groupBy("conv_id").agg(order.alias("t"))
    return found.select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))


def rebuilt(conversations: DataFrame, every: int, most: int) -> DataFrame:
    """(conv_id, ids, words) with the first h turns replaced by those of conversation c - c % every.

    h is the unsigned crc32 of the decimal id, modulo `most`.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    bases = conversations.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, most).alias("first_ids"), F.slice("words", 1, most).alias("first_words")
    )
    rows = conversations.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every}).join(bases, "base", "left")

    def joined(first: str, own: str) -> Column:
        front = F.when(F.col(first).isNotNull(), F.slice(first, F.lit(1), F.col("h"))).otherwise(F.array().cast(conversations.schema[own].dataType))
        rest = F.slice(own, F.col("h") + 1, F.size(own))
        return F.concat(front, rest).alias(own)

    return rows.select("conv_id", joined("first_ids", "ids"), joined("first_words", "words"))


# Trees


class TernaryTree:
    """Nodes of a trie as a ternary search tree: per trie node low, high and equal links.

    Node 0 is the root, without a turn. `up` is the trie parent of a node, made before it.
    """

    def __init__(self) -> None:
        self.key, self.low, self.equal, self.high = (array("q", [-1]) for _ in range(4))
        self.up, self.depth, self.words = array("q", [-1]), array("q", [0]), array("q", [0])
        self.members, self.least = array("q", [0]), array("q", [0])
        self.ends: dict[int, list[int]] = {}

    def _node(self, key: int, up: int, words: int) -> int:
        for links in (self.low, self.equal, self.high):
            links.append(-1)
        self.key.append(key)
        self.up.append(up)
        self.depth.append(self.depth[up] + 1)
        self.words.append(words)
        self.members.append(0)
        self.least.append(0)
        return len(self.key) - 1

    def insert(self, ids: np.ndarray, words: np.ndarray, members: list[int]) -> None:
        """Put in a sequence; `members`, ascending, end at it."""
        node, key = 0, self.key
        for one, size in zip(ids.tolist(), words.tolist()):
            links, at = self.equal, node
            while (child := links[at]) >= 0 and key[child] != one:
                links, at = self.low if one < key[child] else self.high, child
            if child < 0:
                child = links[at] = self._node(one, node, size)
            node = child
        self.members[node], self.least[node] = len(members), members[0]
        self.ends[node] = members

    def path(self, ids: np.ndarray) -> list[int]:
        """The nodes of a sequence that was put in, the root first."""
        nodes, key = [0], self.key
        for one in ids.tolist():
            child = self.equal[nodes[-1]]
            while key[child] != one:
                child = self.low[child] if one < key[child] else self.high[child]
            nodes.append(child)
        return nodes

    def totals(self) -> tuple[array, array, array]:
        """Children, childless nodes and saved tokens of subtrees; members and least ids of subtrees in place.

        A node is made after its parent, so going backwards every node is complete when met.
        """
        n = len(self.key)
        children, leaves, saved = array("q", bytes(8 * n)), array("q", bytes(8 * n)), array("q", bytes(8 * n))
        members, least = self.members, self.least
        for node in range(n - 1, -1, -1):
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * self.words[node]
            if (up := self.up[node]) >= 0:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
                least[up] = min(least[up], least[node]) if members[up] else least[node]
                members[up] += members[node]
        return children, leaves, saved


def middles(n: int) -> Iterator[int]:
    """0..n-1, the middle first, then the middles of both halves and so on."""
    waiting = [(0, n)]
    for start, end in waiting:
        if start < end:
            middle = (start + end) // 2
            yield middle
            waiting += [(start, middle), (middle + 1, end)]


def step(path: bytes, turn: int) -> bytes:
    """The digest of a path that goes on with a turn."""
    return hashlib.sha256(path + turn.to_bytes(8, "little")).digest()


# Rows of a shard: complete nodes (path null), and nodes of its first and last path.
NODES = """conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint,
    saved_tokens bigint, ends_sha256 string, shard int, path binary, parent binary, side int, words bigint, ends string"""


def _shard_rows(sequences: list[tuple[np.ndarray, np.ndarray, list[int]]], shard: int) -> Iterator[tuple]:
    """The nodes of a shard's sequences, which are in order, in the columns of `NODES`."""
    tree = TernaryTree()
    for place in middles(len(sequences)):
        tree.insert(*sequences[place])
    own = {node: len(members) for node, members in tree.ends.items()}
    first, last = tree.path(sequences[0][0]), tree.path(sequences[-1][0])
    open_ = {*first, *last}
    digests = {0: ROOT}
    for node in [*first, *last]:
        if node not in digests:
            digests[node] = step(digests[tree.up[node]], tree.key[node])
    open_children: dict[int, list[int]] = {}  # at most two a node
    for node in open_ - {0}:
        open_children.setdefault(tree.up[node], []).append(node)
    children, leaves, saved = tree.totals()
    members = tree.members

    def ends(node: int) -> str:
        return ",".join(map(str, tree.ends.get(node, ())))

    for node in range(len(tree.key)):
        if node in open_:
            continue
        up = tree.up[node]
        digest = hashlib.sha256(ends(node).encode()).hexdigest() if node in own else NO_ENDS
        at_edge = up in open_  # the parent's least member is known after merging
        yield (
            tree.least[node], tree.depth[node], None if at_edge else tree.least[up], members[node], children[node], leaves[node],
            saved[node], digest, shard, None, digests[up] if at_edge else None, None, None, None,
        )
    # What open nodes hold without their open children, which other shards may hold as well.
    done: set[int] = set()
    for side, path in enumerate((first, last)):
        for node in path:
            new = node not in done
            inside = [0, 0, 0]
            if new:
                below = open_children.get(node, [])
                inside[0] = children[node] - len(below)
                inside[1] = leaves[node] - sum(leaves[c] for c in below) if children[node] else 0
                inside[2] = saved[node] - (members[node] - 1) * tree.words[node] - sum(saved[c] for c in below)
            done.add(node)
            up = tree.up[node]
            yield (
                tree.least[node], tree.depth[node], None, members[node] if new else 0, *inside, None, shard, digests[node],
                digests[up] if up >= 0 else None, side, tree.words[node], ends(node) if new and node in own else None,
            )


def _sharded(conversations: DataFrame, shard_turns: int) -> DataFrame:
    """Nodes of all shards, in the columns of `NODES`."""
    turns = conversations.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    parts = max(1, -(-turns // shard_turns))
    ordered = conversations.repartitionByRange(parts, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    ordered = ordered.select("conv_id", "ids", "words", F.spark_partition_id().alias("shard"))

    def run(batches: Batches) -> Batches:
        sequences: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
        shard = 0
        for batch in batches:
            ids, words = batch.column("ids"), batch.column("words")
            for row, conv in enumerate(batch.column("conv_id").to_pylist()):
                mine = ids[row].values.to_numpy()
                if sequences and np.array_equal(sequences[-1][0], mine):
                    sequences[-1][2].append(conv)
                else:
                    sequences.append((mine, words[row].values.to_numpy(), [conv]))
            shard = batch.column("shard")[0].as_py() if batch.num_rows else shard
        if sequences:
            yield from _to_batches(_shard_rows(sequences, shard))

    return ordered.mapInArrow(run, NODES)


def _to_batches(rows: Iterator[tuple], size: int = 5000) -> Batches:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in NODES.split(","))])
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _ends_of(open_nodes: DataFrame) -> DataFrame:
    """(path, ends_sha256) of open nodes at which members end: texts of shards hashed one after another."""
    texts = open_nodes.where("ends IS NOT NULL").select("path", "shard", "ends")
    texts = texts.repartition("path").sortWithinPartitions("path", "shard")

    def run(batches: Batches) -> Batches:
        path, digest = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([digest.hexdigest()])], names=["path", "ends_sha256"])

        for batch in batches:
            for row in range(batch.num_rows):
                mine, text = batch.column("path")[row].as_py(), batch.column("ends")[row].as_buffer()
                if mine == path:
                    digest.update(b",")
                else:
                    if digest is not None:
                        yield out()
                    path, digest = mine, hashlib.sha256()
                digest.update(text)
        if digest is not None:
            yield out()

    return texts.mapInArrow(run, "path binary, ends_sha256 string")


def _merged(open_nodes: DataFrame) -> DataFrame:
    """(path, parent, then the result's columns) of the nodes that several shards may hold."""
    place = F.struct("shard", "side")
    nodes = open_nodes.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner_children"), F.sum("n_leaves").alias("inner_leaves"),
        F.sum("saved_tokens").alias("inner_saved"), F.first("words").alias("words"), F.min(place).alias("owner"),
    )
    open_children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("open_children"))
    nodes = nodes.join(open_children, "path", "left").withColumn("n_children", F.col("inner_children") + F.coalesce("open_children", F.lit(0)))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    nodes = nodes.withColumn("leaves", F.col("inner_leaves") + leaf)
    nodes = nodes.withColumn("saved", F.col("inner_saved") + (F.col("n_convs") - 1) * F.col("words"))
    nodes = store(nodes, "merged")
    # Every node gives what it has to one path; on each path it is summed from the far end.
    owned = open_nodes.select("path", "depth", "shard", "side").join(nodes.select("path", "owner", "leaves", "saved"), "path")
    mine = F.col("owner") == place
    below = Window.partitionBy("shard", "side").orderBy(F.desc("depth"))
    sums = owned.select(
        "path", *(F.sum(F.when(mine, F.col(c)).otherwise(0)).over(below).alias(c) for c in ("leaves", "saved"))
    )
    sums = sums.groupBy("path").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = nodes.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    found = nodes.join(sums, "path").join(_ends_of(open_nodes), "path", "left").join(parents, "parent", "left")
    return found.select("path", *RESULT[:-1], ends)


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per node of the trie of (conv_id, ids, words); the columns are those of `RESULT`."""
    with scratch(conversations.sparkSession) as scope:
        nodes = store(_sharded(conversations, shard_turns), "nodes")
        open_nodes = nodes.where("path IS NOT NULL")
        merged = store(_merged(open_nodes), "open")
        complete = nodes.where("path IS NULL")
        # Nodes with an open parent look it up in their own shard, so the root's many children spread.
        known = open_nodes.select("shard", "path").distinct().join(merged.select("path", F.col("conv_id").alias("found")), "path")
        known = known.withColumnRenamed("path", "parent")
        looked_up = complete.where("parent IS NOT NULL").drop("parent_conv_id").join(known, ["shard", "parent"])
        looked_up = looked_up.withColumnRenamed("found", "parent_conv_id")
        parts = [complete.where("parent IS NULL"), looked_up, merged]
        out = parts[0].select(*RESULT).unionByName(parts[1].select(*RESULT)).unionByName(parts[2].select(*RESULT))
        return scope.keep(out, "trie")


def conversation_trie(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    every: int = 20,
    most: int = 4,
    shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    with scratch(turns.sparkSession) as scope:
        rows = store(encoded(turns, conv_col, turn_col, role_col, text_col), "sequences")
        found = trie_nodes(rebuilt(rows, every, most), shard_turns)
        scope.release(scope.last())
        return found
