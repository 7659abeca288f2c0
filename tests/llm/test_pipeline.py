import re

import numpy as np
import pytest

import corpus_pipeline
from patronmap.llm import mixing, secrets, simhash
from patronmap.llm.common import tokenizer_path
from patronmap.llm.packing import WordIds
from patronmap.storage import fresh_path
from test_packing import best_fit_decreasing
from test_simhash import slow_components

SF = "/root/testdata/sf0.001"
EXTRA = [
    (900001, None, "en", "src0", None), (900002, "", "de", "src1", 0), (900003, "12 34 !!", "en", None, 8),
    (900004, "a lonely text of its own with password=ab12cd34ef56ab78 in it", "en", None, 60),
    (900005, "the near copies are the same words here " * 30, "en", "src2", 1200),
    (900006, "The near copies are the same words here " * 30, "en", "src3", 1200),
    (900006, "The near copies are the same words here " * 30, "en", "src3", 1200),
    (None, "no id but words enough to be a text that is kept by itself", None, "src1", 58),
]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(EXTRA, docs.schema))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out[-1].columns == docs.columns
            assert [f.dataType for f in out[-1].schema] == [f.dataType for f in docs.schema]
    return [df.collect() for df in out]


def test_language_keeps_clean_documents(stages):
    before, after = stages[0], stages[1]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {900001, 900002, 900003} <= gone
    assert all(r in before for r in after)
    by_id = {r.doc_id: r for r in before}
    assert all(len(by_id[i].text or "") < 100 for i in gone)


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    groups = {}
    for i, _, component in slow_components(rows):
        groups.setdefault(component, []).append(i)
    kept = [r.doc_id for r in stages[2]]
    assert len(kept) == len(set(kept)) == len(groups)
    assert {i for i in kept if i is not None} == {min(i for i in g if i is not None) for c, g in groups.items() if c is not None}
    assert 900005 in kept and 900006 not in kept and None in kept


def test_secrets_are_marked_and_nothing_else_changes(stages):
    before = {r.doc_id: r for r in stages[2]}
    assert len(stages[3]) == len(before)
    for r in stages[3]:
        old = before[r.doc_id]
        assert (r.lang, r.source) == (old.lang, old.source)
        if r.text != old.text:
            assert secrets.MARK in r.text and r.n_chars == len(r.text)
            parts = re.escape(r.text).replace(re.escape(secrets.MARK), r"\S+")
            assert re.fullmatch(parts, old.text)
    assert "ab12cd34ef56ab78" not in {r.doc_id: r for r in stages[3]}[900004].text


def test_mixture_takes_the_words_of_the_mix(spark, stages):
    before = spark.createDataFrame(stages[3], spark.read.parquet(f"{SF}/documents.parquet").schema)
    taken = {r.doc_id: r.taken for r in mixing.mix(before).taken().collect() if r.taken}
    words = {}
    for r in stages[4]:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(mixing.WORD, r.text))
    assert words == taken


def test_sequences_hold_all_tokens_of_the_mixture(stages):
    tokens = WordIds(tokenizer_path("word_bpe_49k.json"))
    wanted = []
    for r in stages[4]:
        n = len(tokens.of([r.text.encode()])[0]) // 4 + 1
        wanted += [(r.doc_id, p, s, min(2048, n - s)) for p, s in enumerate(range(0, n, 2048))]
    found = stages[5]
    assert sorted(((r.doc_id, r.piece, r.start, r.length) for r in found), key=str) == sorted(wanted, key=str)
    held = {}
    for r in found:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(held) <= best_fit_decreasing([w[3] for w in wanted], 2048)


def test_run_applies_all_stages_and_agrees_with_a_rerun(spark):
    first, again = (
        sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
        for _ in range(2)
    )
    assert first == again and len(first) > 100


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert made.collect() == []


def test_columns_with_the_operators_own_names_stay(spark):
    names = ["doc_id", "source", "lang", "text", "n_chars", "_id", "_key", "_parts", "_own0", "_spans", "_size", "a`b"]
    docs = spark.createDataFrame([(1, "s", "en", "password=ab12cd34ef56ab78 is one word of it", 3, *range(7))], ", ".join(
        f"`{n.replace('`', '``')}` {'string' if i in (1, 2, 3) else 'bigint'}" for i, n in enumerate(names)
    ))
    for stage in (simhash.one_of_each_group, secrets.redacted_documents, mixing.mixed_documents):
        found = stage(docs)
        assert found.columns == names
        assert {tuple(r)[5:] for r in found.collect()} == {tuple(range(7))}


def test_key_blocks_are_found_in_linear_time():
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    text = f"{begin} a {begin} b {end} c {end} {begin} d {end} {begin}"
    spans = [text[a:b] for a, b in secrets.key_blocks(text)]
    assert spans == [f"{begin} a {begin} b {end}", f"{begin} d {end}"]
    assert secrets.key_blocks(f"{begin} x\n" * 200_000) == []


def test_parts_of_a_long_document_are_cut_in_linear_time(spark):
    import time

    def seconds(words):
        docs = spark.createDataFrame([(1, "s", "en", " ".join(f"w{i}" for i in range(words)), 0), (2, "t", "en", "x " * words, 0)], "doc_id bigint, source string, lang string, text string, n_chars bigint")
        start = time.perf_counter()
        out = mixing.mixed_documents(docs).collect()
        assert all(r.n_chars == len(r.text) for r in out)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(80_000) < 3 * seconds(20_000) + 5


def test_operators_leave_only_their_results(spark):
    import os

    from patronmap.llm import packing, suffixtree, topk
    from patronmap.storage import shared_folder

    docs = spark.createDataFrame([(i, f"some words of text number {i} password=ab12cd34ef56ab7{i % 10}", "s") for i in range(30)], "doc_id bigint, text string, source string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id bigint, embedding array<float>")
    folder = os.path.join(shared_folder(spark).removeprefix("file:"), "patronmap", spark.sparkContext.applicationId)
    for work in (
        lambda: simhash.simhash_components(docs), lambda: packing.pack(docs, tokenizer_path("word_bpe_49k.json")),
        lambda: topk.top_k(vectors, lambda i: i % 20 == 0), lambda: suffixtree.score_documents(docs), lambda: secrets.scan(docs),
    ):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        work().collect()
        assert len(set(os.listdir(folder)) - before) == 1
