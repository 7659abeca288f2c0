"""SimHash near-duplicates by tiled exact comparison of fingerprints.

A fingerprint has 64 bits; two fingerprints are linked if they differ in at most
`max_distance` bits. Equal fingerprints are one class, so only different ones are compared.
They are dealt into tiles by the population counts of their two halves. The sum of the
differences of these counts is at most the distance, so pairs of tiles, and pairs of blocks
inside them, whose counts differ by more than the radius are skipped; the rest is compared
by numpy exclusive-or and bit counts. Nothing is sampled or banded: the comparison is exact.

A pair of tiles returns a spanning forest of its links instead of all pairs, so a group of
many near copies costs as many rows as it has members, and no component changes. The driver
sees counts per pair of population counts (33 x 33 at most), never fingerprints.

Defined cases: a null or empty text has no word and fingerprint zero; fewer words than a
shingle make one shingle; repeated rows get a row each; a null id is kept and is smallest in
no component that has another id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronmap.llm.common import Batches, inputs, own_names, quoted, scoped, with_text_batches
from patronmap.operators.components import connected_components
from patronmap.storage import store

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 3
TILE = 8192  # fingerprints in a tile
ROWS, COLUMNS = 256, 1024  # of a block inside a pair of tiles
SLICE = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), SLICE):
        part = hashes[start : start + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The frame without its column text and with a column fp."""

    def work(texts, _):
        return {"fp": np.array([fingerprint(t, shingle_words) for t in texts], dtype=np.int64)}

    return with_text_batches(docs, "text", "fp bigint", work)


def _halves(fp) -> tuple:
    return F.bit_count(F.shiftrightunsigned(fp, 32)), F.bit_count(fp.bitwiseAND(0xFFFFFFFF))


def _gap(a: tuple[int, int], b: tuple[int, int]) -> int:
    return max(0, a[0] - b[1], b[0] - a[1])


def tile_plan(cells: list[tuple[int, int, int]], tile: int) -> list[dict]:
    """Groups of tiles from (high count, low count, fingerprints).

    Neighbouring small cells share one tile; a cell larger than a tile is split by hash.
    """
    groups: list[dict] = []
    open_group: dict | None = None
    first = 0
    for hi, lo, n in sorted(cells, key=lambda c: (c[0] + c[1], c[0])):
        if open_group is None or open_group["n"] + n > tile:
            open_group = {"n": 0, "cells": [], "hi": (hi, hi), "lo": (lo, lo)}
            groups.append(open_group)
        open_group["n"] += n
        open_group["cells"].append((hi, lo))
        for name, value in (("hi", hi), ("lo", lo)):
            low, high = open_group[name]
            open_group[name] = (min(low, value), max(high, value))
        if open_group["n"] > tile:
            open_group = None
    for g in groups:
        g["first"], g["tiles"] = first, -(-g["n"] // tile)
        first += g["tiles"]
    return groups


def _sorted_blocks(fps: np.ndarray, size: int):
    """Fingerprints by population count, and the bounds of both halves' counts per block."""
    fps = fps.view(np.uint64)
    hi, lo = np.bitwise_count(fps >> np.uint64(32)), np.bitwise_count(fps & np.uint64(0xFFFFFFFF))
    order = np.lexsort((hi, hi + lo))
    fps, hi, lo = fps[order], hi[order].astype(np.int16), lo[order].astype(np.int16)
    starts = np.arange(0, len(fps), size)
    ends = np.minimum(starts + size, len(fps))
    bounds = [
        (int(hi[s:e].min()), int(hi[s:e].max()), int(lo[s:e].min()), int(lo[s:e].max()))
        for s, e in zip(starts, ends)
    ]
    return fps, list(zip(starts.tolist(), ends.tolist(), bounds))


def _forest(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Join the trees of u and v; returns the links that joined two. `parent` stays flat."""
    made = []
    while True:
        ru, rv = parent[u], parent[v]
        open_ = ru != rv
        if not open_.any():
            return made
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        low, high = np.minimum(ru, rv), np.maximum(ru, rv)
        roots, at = np.unique(high, return_index=True)
        parent[roots] = low[at]
        made.append(np.stack([u[at], v[at]]))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or within one)."""
    left, left_blocks = _sorted_blocks(a, ROWS)
    right, right_blocks = _sorted_blocks(b, COLUMNS)
    nodes = left if same else np.concatenate([left, right])
    shift = 0 if same else len(left)
    parent = np.arange(len(nodes))
    made: list[np.ndarray] = []
    for s, e, (h0, h1, l0, l1) in left_blocks:
        for t, f, (g0, g1, m0, m1) in right_blocks:
            if same and f <= s:
                continue
            if _gap((h0, h1), (g0, g1)) + _gap((l0, l1), (m0, m1)) > radius:
                continue
            near = np.bitwise_count(left[s:e, None] ^ right[None, t:f]) <= radius
            i, j = np.nonzero(near)
            i, j = i + s, j + t
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                made += _forest(parent, i, j + shift)
    if not made:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    links = np.concatenate(made, axis=1)
    return nodes[links[0]].view(np.int64), nodes[links[1]].view(np.int64)


def near_links(classes: DataFrame, max_distance: int = MAX_DISTANCE, tile: int = TILE) -> DataFrame:
    """(src, dst): links that span the components of the different fingerprints in `classes.fp`."""
    spark = classes.sparkSession
    hi, lo = _halves(F.col("fp"))
    keyed = classes.select("fp", hi.alias("hi"), lo.alias("lo"))
    cells = [(r.hi, r.lo, r["count"]) for r in keyed.groupBy("hi", "lo").count().collect()]
    groups = tile_plan(cells, tile)
    where = [(h, l, g["first"], g["tiles"]) for g in groups for h, l in g["cells"]]
    place = spark.createDataFrame(where, "hi int, lo int, first int, tiles int")
    spots = F.col("first") + F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiles = store(
        keyed.join(F.broadcast(place), ["hi", "lo"])  # 33 x 33 rows at most
        .groupBy(spots.alias("tile"))
        .agg(F.collect_list("fp").alias("fps")),
        "tiles",
    )
    meet = [
        (a["first"], a["tiles"], b["first"], b["tiles"])
        for i, a in enumerate(groups)
        for b in groups[i:]
        if _gap(a["hi"], b["hi"]) + _gap(a["lo"], b["lo"]) <= max_distance
    ]
    pairs = (
        spark.createDataFrame(meet, "fa int, na int, fb int, nb int")
        .select("fa", "fb", "nb", F.explode(F.expr("sequence(fa, fa + na - 1)")).alias("a"))
        .select("a", F.explode(F.expr("sequence(fb, fb + nb - 1)")).alias("b"))
        .where("a <= b")
    )
    n_pairs = sum(m[1] * m[3] for m in meet)
    n_tasks = max(1, min(n_pairs, 8 * spark.sparkContext.defaultParallelism))
    both = (
        pairs.join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fps_a")), "a")
        .join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fps_b")), "b")
        .repartition(n_tasks, "a", "b")
    )

    def compare(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (batch.column(c)[row].values.to_numpy() for c in ("fps_a", "fps_b"))
                same = batch.column("a")[row].as_py() == batch.column("b")[row].as_py()
                src, dst = tile_links(a, b, same, max_distance)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return both.select("a", "b", "fps_a", "fps_b").mapInArrow(compare, "src bigint, dst bigint")


@scoped("components")
def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
    tile: int = TILE,
) -> DataFrame:
    """A row per row of `docs`: doc_id, fingerprint, component_id, text_key, keep.

    component_id is the smallest id that links reach, the own included. keep marks the row
    that stands for its component: the smallest (id, hash of the text); text_key is that
    hash. Repeated rows share their keep.
    """
    rows = inputs(docs, doc_id=id_col, text=text_col)
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    prints = store(fingerprints(rows, shingle_words), "fingerprints")
    chief = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key"))
    classes = store(prints.groupBy("fp").agg(chief.alias("chief")), "classes")
    links = store(near_links(classes, max_distance, tile), "links")
    linked = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    labels = connected_components(linked, links)
    roots = classes.join(labels.withColumnRenamed("node", "fp"), "fp")
    chiefs = roots.groupBy("label").agg(F.min("chief").alias("best"))
    merged = roots.join(chiefs, "label").select("fp", "best")
    heads = classes.join(merged, "fp", "left").select("fp", F.coalesce("best", "chief").alias("head"))
    # A fingerprint may hold a third of all rows; adaptive execution splits its partition.
    return prints.join(heads, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"),
        "text_key",
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & F.col("text_key").eqNullSafe(F.col("head.text_key"))).alias("keep"),
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stand for their components, with all their columns, once each."""
    found = simhash_components(docs, id_col, text_col, **options)
    id_, key_, gone_ = own_names(docs, 3)
    keyed = docs.withColumns({id_: F.col(quoted(id_col)), key_: F.xxhash64(quoted(text_col))})
    # Rows that stand for others are told by what goes, which is little, so the other texts need not move twice.
    gone = found.where("NOT keep").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key_)).distinct()
    gone = gone.withColumn(gone_, F.lit(True))
    same = keyed[id_].eqNullSafe(gone[id_]) & keyed[key_].eqNullSafe(gone[key_])
    kept = keyed.join(gone, same, "left_anti")
    return kept.dropDuplicates([id_, key_]).select(*map(quoted, docs.columns))
