import math
import zlib
from collections import Counter

import numpy as np
import pytest

from patronmap.llm import suffixtree

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, score string, key int, word string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "w", 2) for i, t in rows], SCHEMA)


def tokens_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").split()] + [None]


def slow_base(rows, folds=10):
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % folds == 0}
    counts = Counter(w for i, t in rows if i not in held for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = tokens_of(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((i, i in held, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_words", [0, 3, 1000])
def test_base_equals_brute_force(spark, hot_words):
    rows = [(i, f"The of the word{i} and É é wörd{i % 3} THE") for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \t\n"), (None, "a b"), (7, "The of the"), (53, "x" * 200), (60, "new words only"), (61, "é " * 3000)]
    found = suffixtree.score_documents(frame(spark, rows), hot_words=hot_words).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=str)
    assert got == slow_base(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def slow_score(rows, tree, text):
    """A byte at a time."""
    stream = suffixtree.PAD + suffixtree.spell((text or "").encode().lower().split())
    total = 0.0
    for at in range(suffixtree.DEPTH, len(stream)):
        state = best = 0
        for back in range(1, suffixtree.DEPTH + 1):
            state = tree.step[state, tree.column[stream[at - back]]]
            if state == len(tree.step) - 1:
                break
            best = state
        total += tree.logs[best, tree.column[stream[at]]]
    return total


def test_tree_equals_brute_force_counts(spark):
    texts = [f"the cat {i % 5} sat on the mat and the dog {i % 3} ran" for i in range(60)]
    counts = Counter()
    for t in texts:
        stream = suffixtree.PAD + suffixtree.spell(t.encode().split())
        for at in range(suffixtree.DEPTH, len(stream)):
            for k in range(suffixtree.DEPTH + 1):
                counts[stream[at - k : at][::-1], stream[at]] += 1
    totals = Counter()
    for (context, _), n in counts.items():
        totals[context] += n
    gains = Counter()
    for (context, symbol), n in counts.items():
        if context:
            shorter = counts[context[:-1], symbol] / totals[context[:-1]]
            gains[context] += n * math.log(n / totals[context] / shorter)
    passed = {c for c, g in gains.items() if g > suffixtree.LEAST_GAIN}
    kept = {c[:k] for c in passed for k in range(len(c) + 1)} | {b""}
    made = suffixtree.store(suffixtree.corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string")))
    rows = suffixtree.kept_contexts(made.where("kind = 1").select("key", "n")).collect()
    got = {(r.context.to_bytes(8, "little")[: r.level], r.symbol): r.n for r in rows}
    assert got == {k: n for k, n in counts.items() if k[0] in kept}
    tree = suffixtree.fit_tree(made.where("kind = 1").select("key", "n"))
    shares = 10.0 ** tree.logs.astype(np.float64)
    unseen = 256 - (shares.shape[1] - 1)
    assert np.allclose(shares[:, :-1].sum(axis=1) + unseen * shares[:, -1], 1, atol=1e-4)
    some = ["the cat", "", "é zz", texts[0]]
    fast = tree.scores([suffixtree.spell(t.encode().lower().split()) for t in some])
    assert fast == pytest.approx([slow_score(None, tree, t) for t in some], rel=1e-6)


def test_scores_do_not_depend_on_which_contexts_are_broadcast(spark):
    words = ["cat", "dog", "tree", "é", "漢字", "house", "mat", "zebra"]
    rows = [(i, " ".join(words[(i * k + k) % (3 + i % 6)] for k in range(30))) for i in range(200)]
    rows += [(300, None), (301, "unseen ~bytes^ catdog"), (None, "cat dog"), (302, "cat " * 500)]
    whole, *others = (
        sorted(((str(r.doc_id), r.score) for r in suffixtree.score_documents(frame(spark, rows), hot_contexts=n).collect()))
        for n in (10**6, 0, 30, 200)
    )
    for found in others:
        assert [i for i, _ in found] == [i for i, _ in whole]
        assert [s for _, s in found] == pytest.approx([s for _, s in whole], rel=1e-5)


def test_contexts_stay_when_other_texts_dominate(spark):
    rare = ["qoph qaph qoph"] * 8
    texts = rare + ["the cat sat on the mat " * 10000] * 40  # 9,200,000 positions, of which a share of 2e-6 are 18
    counts = suffixtree.store(suffixtree.corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string")))
    rows = suffixtree.kept_contexts(counts.where("kind = 1").select("key", "n")).collect()
    kept = {r.context.to_bytes(8, "little")[: r.level][::-1] for r in rows}
    few = suffixtree.store(suffixtree.corpus_counts(spark.createDataFrame([(t,) for t in rare + ["the cat sat on the mat"] * 40], "text string")))
    alone = {
        r.context.to_bytes(8, "little")[: r.level][::-1]
        for r in suffixtree.kept_contexts(few.where("kind = 1").select("key", "n")).collect()
    }
    assert b"qa" in kept and {c for c in alone if b"q" in c} <= kept


def test_scores_beat_the_base_on_held_out_texts(spark):
    found = suffixtree.score_documents(spark.read.parquet(f"{SF}/documents.parquet"))
    held = found.where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert held.s > held.b


def test_tables_without_training_rows(spark):
    assert suffixtree.score_documents(frame(spark, [])).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = suffixtree.score_documents(frame(spark, [(held, "ab")])).collect()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0)
    assert row.score == pytest.approx(4 * math.log10(1 / 256), rel=1e-5)
