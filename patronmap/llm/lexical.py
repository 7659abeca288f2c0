"""Exact ranked lexical search over an index stratified by document length.

A document of n terms has the normaliser m = 100 - 90 + (90 n N) div L, for N documents with L
terms. The index keeps pieces of about a million terms each. In a piece the documents of equal
m are a stratum; the postings of a term in a stratum are ordered by tf, and as m is the same for
all of them, the impact (10^9 tf) div (1000 tf + 8 m) is computed once per stratum and tf.

A search takes the items in blocks; every block meets every piece. The sum, over an item's
terms, of the weight times the impact of the largest tf in a stratum bounds the scores there.
Strata are visited in falling order of that bound until it is below the kth score so far (a
task carries that from piece to piece); bounds equal to it are visited, for ties. In a visited
stratum whole scores are summed from the postings. The best of all tasks are merged per item.
Scores are whole numbers: summed as doubles where no sum can reach 2^53, as 64-bit integers else.

Documents are dealt to pieces by bytes, in classes of at most 1/32 of a doubling, and within a
class at random, so any number of documents of one length is spread. Texts move once. What is
broadcast are the at most 1,000 classes, and the terms asked for, if the index is made for
known queries and these are few; the results are the same without.

Defined cases: a null text, or one without a term, is in no count and in no result; repeated rows
are documents of their own, with ranks of their own; a document with a null id is ranked behind
equal scores; rows with the same item id are one item with the terms of all; an item without a
known term has no rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronmap.llm.common import Batches, Texts, ascii_lower, inputs, with_text_batches
from patronmap.operators.segments import broadcast_if_small
from patronmap.storage import scratch, store

# A term is a run of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWERED = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
PIECE_TERMS = 1_000_000  # terms of the documents of a piece
BLOCK_ITEMS = 256  # items of a block, on average
CLASSES = 32  # classes of bytes to a doubling
WANTED_TERMS, WANTED_BYTES = 500_000, 1 << 25  # most terms that an index is restricted to
EXACT = float(1 << 53)
# Impact: (ONE tf) div (1000 tf + SPREAD m); m: LEAST + (SLOPE n N) div L.
ONE, SPREAD, LEAST, SLOPE = 1_000_000_000, 8, 10, 90

PIECE_SCHEMA = """ids array<bigint>, ms array<bigint>, first_doc array<int>, terms array<string>, dfs array<int>,
    stratum array<int>, term array<int>, tf array<int>, first_posting array<int>, docs array<int>"""
PIECE_COLUMNS = ("ids", "ms", "first_doc", "terms", "dfs", "stratum", "term", "tf", "first_posting", "docs")


def words_of(text: bytes) -> list[bytes]:
    """All terms of a text in UTF-8, in order."""
    return text.translate(LOWERED).split()


def terms_of(text: Column) -> Column:
    """The same for a column; null for a null text."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


# Index


@dataclass
class Index:
    """Pieces of an index, and the numbers of documents and terms that it counts."""

    pieces: DataFrame
    documents: int
    terms: int


class _Builder:
    """Collects the documents of a piece."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.ms: list[int] = []
        self.numbers: dict[bytes, int] = {}  # of terms, by first appearance
        self.term: list[int] = []
        self.tf: list[int] = []
        self.sizes: list[int] = []
        self.counted = 0

    def add(self, doc: int | None, m: int, words: list[bytes], wanted: set[bytes] | None) -> None:
        counts = Counter(words)
        kept = counts.keys() if wanted is None else counts.keys() & wanted
        numbers = self.numbers
        self.term += [numbers.setdefault(t, len(numbers)) for t in kept]
        self.tf += [counts[t] for t in kept]
        self.sizes.append(len(kept))
        self.ids.append(doc)
        self.ms.append(m)
        self.counted += len(words)

    def piece(self) -> pa.RecordBatch:
        m = np.array(self.ms, np.int64)
        order = np.argsort(m, kind="stable")
        ms, first_doc = np.unique(m[order], return_index=True)
        place = np.empty(len(m), np.int32)
        place[order] = np.arange(len(m))
        doc = place[np.repeat(np.arange(len(m)), self.sizes)]
        stratum = (np.searchsorted(first_doc, doc, side="right") - 1).astype(np.int32)
        term, tf = np.array(self.term, np.int32), np.array(self.tf, np.int32)
        by = np.lexsort((doc, tf, term, stratum))
        stratum, term, tf, doc = stratum[by], term[by], tf[by], doc[by]
        first = np.flatnonzero(_changes(stratum, term, tf))
        ids = pa.array([self.ids[i] for i in order], pa.int64())
        columns = {
            "ids": ids,
            "ms": ms,
            "first_doc": first_doc.astype(np.int32),
            "terms": pa.array([t.decode() for t in self.numbers], pa.string()),
            "dfs": np.bincount(term, minlength=len(self.numbers)).astype(np.int32),
            "stratum": stratum[first],
            "term": term[first],
            "tf": tf[first],
            "first_posting": first.astype(np.int32),
            "docs": doc.astype(np.int32),
        }
        lists = []
        for values in columns.values():
            values = values if isinstance(values, pa.Array) else pa.array(values)
            lists.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        return pa.RecordBatch.from_arrays(lists, names=list(columns))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    first = np.ones(len(columns[0]), bool)
    if len(first):
        first[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return first


def _wanted(terms: DataFrame | None) -> set[bytes] | None:
    """The terms an index is restricted to, if they are few enough to be sent to all tasks."""
    if terms is None:
        return None
    terms = terms.select("term").distinct()
    n, size = terms.limit(WANTED_TERMS + 1).agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    if n > WANTED_TERMS or (size or 0) > WANTED_BYTES:
        return None
    return {r.term.encode() for r in terms.collect()}


def index_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    terms: DataFrame | None = None,
    piece_terms: int = PIECE_TERMS,
) -> Index:
    """An index of all documents with a term; all count, whatever `terms` (a column term) is.

    With `terms` the index holds postings of these alone, unless they are too many to be
    sent around.
    """
    spark = docs.sparkSession
    rows = inputs(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    size = F.octet_length("text")
    rows = rows.where(size > 0).withColumn("class", F.floor(F.log2(size) * CLASSES).cast("int"))
    sizes = with_text_batches(
        rows.select("class", "text"), "text", "n bigint", lambda texts, _: {"n": pa.array([len(words_of(t)) for t in texts], pa.int64())}
    )
    classes = sizes.groupBy("class").agg(F.count_if(F.col("n") > 0).alias("rows"), F.sum("n").alias("terms")).sort("class").collect()
    documents, total = sum(r.rows for r in classes), sum(r.terms for r in classes)
    starts, at = [], 0
    for r in classes:  # CLASSES for each doubling of the bytes: 1,000 at most
        starts.append((r["class"], at, r.terms))
        at += r.terms
    starts = F.broadcast(spark.createDataFrame(starts, "class int, start bigint, terms bigint"))
    parts = max(1, -(-total // piece_terms))
    # The number of a row depends on the files alone, so a lost task deals its rows as before.
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / float(1 << 20)
    piece = F.floor((F.col("start") + F.col("terms") * F.col("chance")) / piece_terms).cast("int")
    placed = rows.withColumn("chance", chance).join(starts, "class").select("doc_id", "text", piece.alias("piece"))
    placed = placed.repartition(parts, "piece").sortWithinPartitions("piece")
    wanted = spark.sparkContext.broadcast(_wanted(terms))

    def run(batches: Batches) -> Batches:
        made = _Builder()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), Texts(batch.column("text"))
            for doc, text in zip(ids, texts):
                words = words_of(text)
                if not words:
                    continue
                if made.ids and made.counted + len(words) > piece_terms:
                    yield made.piece()
                    made = _Builder()
                made.add(doc, LEAST + SLOPE * len(words) * documents // total, words, wanted.value)
        if made.ids:
            yield made.piece()

    pieces = store(placed.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA), "index")
    return Index(pieces, documents, total)


# Search


class Piece:
    """A piece of the index in memory."""

    def __init__(self, row: dict[str, pa.Scalar]):
        get = lambda name: row[name].values.to_numpy(zero_copy_only=False)
        self.ids = row["ids"].values
        self.terms = row["terms"].values
        ms, stratum, term, tf, first = (get(c) for c in ("ms", "stratum", "term", "tf", "first_posting"))
        self.strata = len(ms)
        self.docs = get("docs")
        self.edges = np.append(get("first_doc"), len(self.ids)).astype(np.int64)
        # An impact per stratum and tf, then for every posting.
        pairs, of = np.unique(stratum.astype(np.int64) << 32 | tf, return_inverse=True)
        tfs = pairs & 0xFFFFFFFF
        impacts = (ONE * tfs // (1000 * tfs + SPREAD * ms[pairs >> 32]))[of]
        self.impact = np.repeat(impacts, np.diff(np.append(first, len(self.docs))))
        # Runs: the postings of a term in a stratum, with the impact of the last, largest tf.
        runs = np.flatnonzero(_changes(stratum, term))
        self.width = len(self.terms) + 1
        self.keys = stratum[runs].astype(np.int64) * self.width + term[runs]
        self.most = impacts[np.append(runs[1:], len(stratum)) - 1] if len(runs) else impacts
        self.edges_of_runs = np.append(first[runs], len(self.docs)).astype(np.int64)


class Block:
    """Items with terms and weights, and the best documents found for each."""

    def __init__(self, items: list[dict], k: int):
        self.k = k
        self.item_ids = [i["item_id"] for i in items]
        entries = [i["entries"] for i in items]
        self.offsets = np.cumsum([0, *map(len, entries)])
        numbers: dict[str, int] = {}
        self.term = np.array([numbers.setdefault(e["term"], len(numbers)) for some in entries for e in some], np.int64)
        self.terms = pa.array(numbers, pa.string())
        self.weight = np.array([e["w"] for some in entries for e in some], np.int64)
        none = np.empty(0, np.int64)
        self.best = [(none, none, none.astype(bool)) for _ in items]  # scores, ids, whether the id is null
        self.floor = [0] * len(items)  # a score below it is not among the best
        self.visited = self.offered = 0

    def search(self, piece: Piece) -> None:
        """Take what a piece has for the items."""
        local = pc.index_in(self.terms, value_set=piece.terms).fill_null(-1).to_numpy()[self.term]
        keys = np.arange(piece.strata)[:, None] * piece.width + np.where(local < 0, piece.width - 1, local)
        run = np.searchsorted(piece.keys, keys)
        found = np.append(piece.keys, -1)[run] == keys
        gains = np.where(found, np.append(piece.most, 0)[run] * self.weight, 0)
        bounds = np.add.reduceat(gains, self.offsets[:-1], axis=1)  # every item has a term
        order = np.argsort(-bounds, axis=0, kind="stable")
        self.offered += int((bounds > 0).sum())
        ids = piece.ids.fill_null(0).to_numpy()
        null = piece.ids.is_null().to_numpy(zero_copy_only=False)
        for item, (start, end) in enumerate(zip(self.offsets, self.offsets[1:])):
            for stratum in order[:, item]:
                bound = bounds[stratum, item]
                if bound <= 0 or bound < self.floor[item]:
                    break
                self.visited += 1
                at = np.flatnonzero(found[stratum, start:end]) + start
                scores = self._scores(piece, stratum, run[stratum, at], self.weight[at], bound)
                good = np.flatnonzero(scores >= max(1, self.floor[item]))
                if len(good):
                    docs = good + piece.edges[stratum]
                    self._take(item, scores[good], ids[docs], null[docs])

    @staticmethod
    def _scores(piece: Piece, stratum: int, runs: np.ndarray, weights: np.ndarray, bound: int) -> np.ndarray:
        """Whole scores of the documents of a stratum, from the postings of these runs."""
        starts, ends = piece.edges_of_runs[runs], piece.edges_of_runs[runs + 1]
        sizes = ends - starts
        before = np.cumsum(sizes) - sizes
        postings = np.arange(sizes.sum()) + np.repeat(starts - before, sizes)
        docs = piece.docs[postings] - piece.edges[stratum]
        gains = piece.impact[postings] * np.repeat(weights, sizes)
        n = piece.edges[stratum + 1] - piece.edges[stratum]
        if bound < EXACT:
            return np.bincount(docs, gains, minlength=n).astype(np.int64)
        scores = np.zeros(n, np.int64)
        np.add.at(scores, docs, gains)
        return scores

    def _take(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        old = self.best[item]
        scores, ids, null = (np.concatenate(pair) for pair in zip(old, (scores, ids, null)))
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.best[item] = scores[order], ids[order], null[order]
        if len(order) == self.k:
            self.floor[item] = int(scores[order[-1]])

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        counts = [len(s) for s, _, _ in self.best]
        scores, ids, null = (np.concatenate(x) for x in zip(*self.best))
        items = pa.array(self.item_ids, kind).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
        return pa.RecordBatch.from_arrays(
            [items, pa.array(ids, pa.int64(), mask=null), pa.array(scores, pa.int64())], names=["item_id", "doc_id", "score"]
        )


def _item_terms(queries: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, term), each once."""
    given = inputs(queries, item_id=item_col, text=text_col)
    return given.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()


def _blocks(index: Index, items: DataFrame, block_items: int) -> tuple[DataFrame, int]:
    """(block, items with weighted terms), and the number of blocks."""
    counts = index.pieces.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select("x.terms", "x.dfs")
    asked = broadcast_if_small(items.select(F.col("term").alias("terms")).distinct())
    dfs = counts.join(asked, "terms").groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df"))
    odds = F.lit(2.0 * index.documents + 2.0) / (2 * F.col("df") + 1).cast("double")
    weighted = items.join(dfs, "term").withColumn("w", F.floor(1000 * F.log(odds)).cast("bigint"))
    weighted = weighted.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("entries"))
    weighted = store(weighted, "weights")
    n = max(1, -(-weighted.count() // block_items))
    block = F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")
    return weighted.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item_id", "entries")).alias("items")), n


def search(
    index: Index,
    queries: DataFrame,
    k: int = 10,
    item_col: str = "item_id",
    text_col: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, of scores above 0."""
    spark = queries.sparkSession
    with scratch(spark) as scope:
        items = store(_item_terms(queries, item_col, text_col), "items")
        blocks, n = _blocks(index, items, block_items)
        blocks = broadcast_if_small(store(blocks, "blocks"))
        numbers = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")
        both = index.pieces.select("*", numbers).join(blocks, "block")
        kind = items.schema["item_id"]
        found = both.mapInArrow(_searcher(k), T.StructType([kind, *T._parse_datatype_string("doc_id bigint, score bigint").fields]))
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return scope.keep(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")


def _searcher(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Batches:
        blocks: dict[int, Block] = {}
        kind = None
        for batch in batches:
            items = batch.column("items")
            kind = items.type.value_type.field("item_id").type
            for row in range(batch.num_rows):
                number = batch.column("block")[row].as_py()
                if number not in blocks:
                    blocks[number] = Block(items[row].as_py(), k)
                blocks[number].search(Piece({c: batch.column(c)[row] for c in PIECE_COLUMNS}))
        for block in blocks.values():
            yield block.rows(kind)

    return run


def ranked(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    piece_terms: int = PIECE_TERMS,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The k best documents of every item, with an index made for the items' terms alone."""
    with scratch(docs.sparkSession) as scope:
        asked = store(_item_terms(queries, item_col, item_text).select("term").distinct(), "asked")
        index = index_documents(docs, id_col, text_col, asked, piece_terms)
        found = search(index, queries, k, item_col, item_text, block_items)
        scope.release(scope.last())
        return found
