import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from patronmap.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, label int, node string, keep int"


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                parent[root(a)] = root(b)
    first = {}
    for x, (i, _) in enumerate(prints):
        if i is not None:
            first[root(x)] = min(first.get(root(x), i), i)
    return sorted(((i, f"{fp:016x}", first.get(root(x))) for x, (i, fp) in enumerate(prints)), key=str)


def result(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1, None, 0) for i, t in rows], SCHEMA)
    found = simhash.simhash_components(df, **options).collect()
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=str)


def texts(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    made = []
    for _ in range(n):
        if made and draw.random() < 0.5:
            copy = draw.choice(made).split(" ")
            for _ in range(draw.choice([0, 1, 1, 2])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            made.append(" ".join(copy))
        else:
            made.append(" ".join(draw.choices(words, k=draw.randint(60, 400))))
    return made


def test_equals_brute_force_over_many_tiles(spark):
    rows = list(enumerate(texts(3, 150)))
    assert result(spark, rows, tile=16) == slow_components(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (5, "one"), (6, "two words"), (7, "ÄÖ Ü ß"), (None, "one")]
    rows += [(8, "äö ü ß"), (9, "a b c d"), (10, "x " * 70000)]
    assert result(spark, rows) == slow_components(rows)


def test_empty_table(spark):
    assert result(spark, []) == []
    assert simhash.one_of_each_group(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tile_links_span_the_components():
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << draw.integers(0, 64, (40, 30), dtype=np.uint64)
    fps = np.unique((base[:, None] ^ flips).ravel()).view(np.int64)
    src, dst = simhash.tile_links(fps, fps, True, 2)
    assert (np.bitwise_count((src ^ dst).view(np.uint64)) <= 2).all()
    assert len(src) == len(fps) - 40  # a forest: no more links than needed


def test_tile_plan_splits_and_merges():
    groups = simhash.tile_plan([(10, 10, 5), (10, 11, 5), (16, 16, 100), (20, 20, 3)], 20)
    assert [g["tiles"] for g in groups] == [1, 5, 1]
    assert [g["first"] for g in groups] == [0, 1, 6]


def test_one_row_of_each_group_stays_with_its_columns(spark):
    rows = [(3, "same old words here"), (1, "Same old words here"), (1, "Same old words here"), (2, "other words are these"), (None, "other words are these"), (None, "alone in this table")]
    df = spark.createDataFrame([(i, t, "p", 4, "n", 7) for i, t in rows], SCHEMA)
    kept = simhash.one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.fp, r.label) for r in kept.collect()) == [(0, "p", 4), (1, "p", 4), (2, "p", 4)]


def test_spark_hash_is_the_one_used(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", simhash.SEED)
