import math
import random
import re
from collections import Counter

import pytest

from patronmap.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id bigint, text string, m string, n int, class int, piece string"
ITEMS = "item_id bigint, text string, term string, w int"


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def brute(docs, items, k):
    """Every document scored for every item, in Python integers."""
    made = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    total, n = sum(x[2] for x in made), len(made)
    df = Counter(t for _, c, _ in made for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, asked in wanted.items():
        scores = []
        for doc, counts, size in made:
            m = 10 + 90 * size * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t in asked & counts.keys()
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -s) for rank, (s, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def result(spark, docs, items, k=10, **options):
    left = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    return sorted([tuple(r) for r in lexical.ranked(left, right, k, **options).collect()], key=str)


def corpus(n, seed=1):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "日本", "x_y", "A1", "Z"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.choice([1, 3, 9, 30, 200])))) for i in range(n)]
    items = [(i, "; ".join(draw.choices(words, k=draw.choice([1, 4, 12])))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_equals_brute_force(spark, k):
    docs, items = corpus(300)
    assert result(spark, docs, items, k, piece_terms=700, block_items=7) == brute(docs, items, k)


def test_nulls_ties_repeats_and_long_texts(spark):
    docs, items = corpus(60, seed=2)
    docs += [(None, "w1 w2"), (None, "w1 w2"), (900, None), (901, ""), (902, "-- !"), (903, "w3 " * 30000), (904, "\x00w1\x7fw2")]
    docs += [(i % 7, "same text here w1") for i in range(80)]  # copies, also of ids
    items += [(None, "w1"), (500, None), (501, ""), (502, "unknown"), (503, "W1 w1, w1"), (1, "w5 w6"), (504, "w3 here")]
    for options in ({}, {"piece_terms": 50, "block_items": 3}):
        assert result(spark, docs, items, 10, **options) == brute(docs, items, 10)


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a")]) == []
    assert result(spark, [(1, "a")], []) == []
    assert result(spark, [(1, None)], [(1, "a")]) == []
    assert result(spark, [(1, "a")], [(1, "a")]) == brute([(1, "a")], [(1, "a")], 10)


def test_index_of_all_terms_serves_later_queries(spark):
    docs, items = corpus(120, seed=3)
    index = lexical.index_documents(spark.createDataFrame(docs, "doc_id int, text string"), piece_terms=500)
    assert index.documents == 120 and index.terms == sum(len(terms(t)) for _, t in docs)
    for some in (items[:5], items[5:]):
        found = lexical.search(index, spark.createDataFrame(some, "item_id bigint, text string"))
        assert sorted([tuple(r) for r in found.collect()], key=str) == brute(docs, some, 10)


def test_bounds_leave_strata_out(spark):
    docs, items = corpus(2000, seed=4)
    index = lexical.index_documents(spark.createDataFrame(docs, "doc_id int, text string"), piece_terms=20000)
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    blocks, _ = lexical._blocks(index, lexical._item_terms(queries, "item_id", "text"), 100)
    block = lexical.Block(blocks.first().asDict(recursive=True)["items"], 3)
    for batch in index.pieces.toArrow().to_batches():
        for row in range(batch.num_rows):
            block.search(lexical.Piece({c: batch.column(c)[row] for c in lexical.PIECE_COLUMNS}))
    assert 0 < block.visited < block.offered


def test_scores_beyond_doubles_are_whole(spark):
    piece = type("P", (), {})()
    import numpy as np

    piece.docs, piece.impact = np.array([0, 1, 0]), np.array([1 << 55, 3, 1])
    piece.edges, piece.edges_of_runs = np.array([0, 2]), np.array([0, 2, 3])
    scores = lexical.Block._scores(piece, 0, np.array([0, 1]), np.array([1, 1]), 1 << 56)
    assert scores.tolist() == [(1 << 55) + 1, 3]
