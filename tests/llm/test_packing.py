import bisect
import random
import zlib

import numpy as np
import pytest

from patronmap.llm import packing
from patronmap.llm.common import tokenizer_path

SCHEMA = "doc_id bigint, text string, piece string, length string, rank int, sequence_id int"
PATH = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(tokenizer_path(PATH))


def best_fit_decreasing(items, capacity):
    gaps, n = [], 0
    for item in sorted(items, reverse=True):
        at = bisect.bisect_left(gaps, item)
        if at == len(gaps):
            n, gap = n + 1, capacity - item
        else:
            gap = gaps.pop(at) - item
        bisect.insort(gaps, gap)
    return n


@pytest.mark.parametrize("seed", range(40))
def test_rounds_place_everything_as_tightly_as_best_fit_decreasing(seed):
    draw = random.Random(seed)
    capacity = draw.choice([1, 10, 50, 2048])
    counts = {draw.randint(1, capacity): draw.randint(1, draw.choice([1, 5, 300])) for _ in range(60)}
    placed, sequences, _ = packing.plan_rounds(counts, capacity)
    held = {}
    for length, found in placed.items():
        rank = 0
        for p in found:
            assert p.rank == rank
            rank += p.count
            for t in range(p.count):
                held.setdefault(p.sequence + t // p.each, []).append((p.offset + t % p.each * length, length))
        assert rank == counts[length]
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    items = [n for n, c in counts.items() for _ in range(c)]
    assert len(held) == sequences <= best_fit_decreasing(items, capacity)


ODD = [
    "", "  ", "it's I'LL O'Brien's don't.", "a.b.c x... ..., ?!", "<|endoftext|>hi <|startoftext|>,. ÀÉ.", "<|ENDOFTEXT|> <|",
    "İstanbul. ẞtraße, ΑΣ. Σ, ς.", "é. café. 12.5, 3rd, ²., ½.", "\x1ca. \x85b, c d.  e.", "日本, 한국. ª. ʰ, Ⅷ. ⓐ.",
    "Éa. × a×. ÷, ÿ! ø;", "é, ́a. ﻿x, \x00y.", "%%%. a%%%. ###",
]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_tokenizers(words, text):
    expected = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.of([text.encode()])[0], "<u4").tolist() == expected


def test_forgetting_words_changes_no_ids():
    few = packing.WordIds(tokenizer_path(PATH), known_words=5)
    for text in ODD[:4] * 2:
        expected = few.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(few.of([text.encode()])[0], "<u4").tolist() == expected


def test_round_trip(spark, words):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choices(["the", "Ereaea.", "xy,", "lang-word"], k=draw.randint(0, 90)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "the " * 500), (7, "the"), (7, "the"), (None, "the xy")]
    df = spark.createDataFrame([(i, t, "a", "b", 1, 2) for i, t in rows], SCHEMA)
    found = packing.pack(df, tokenizer_path(PATH), capacity=64).collect()
    expected = []
    for i, text in rows:
        ids = [*words.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[start : start + 64], dtype="<u4")
            expected.append((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == sorted(expected, key=str)
    held = {}
    for r in found:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len(held) <= best_fit_decreasing([e[3] for e in expected], 64)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path(PATH)).collect() == []


class Recorder:
    """A tokenizer that notes the words it is given."""

    def __init__(self, inner):
        self.inner, self.given = inner, []

    def encode_batch_fast(self, texts, **options):
        self.given += [word for text in texts for word in text.split()]
        return self.inner.encode_batch_fast(texts, **options)


def test_only_words_never_met_are_tokenized():
    found = packing.WordIds(tokenizer_path(PATH))
    whole = found.tokenizer
    found.tokenizer, found.splitter = Recorder(found.tokenizer), Recorder(found.splitter)
    found.of([b"the lyon \xc3\x89t\xc3\xa9 , $$$"])
    text = "The, LYON$$$ Été$$$ the$$$ lyon, new, the"
    for recorder in (found.tokenizer, found.splitter):
        recorder.given.clear()
    ids = np.frombuffer(found.of([text.encode()])[0], "<u4").tolist()
    assert found.tokenizer.given + found.splitter.given == ["new"]
    assert ids == whole.encode(text, add_special_tokens=False).ids


def test_ids_of_words_with_any_signs_are_the_tokenizers():
    draw = random.Random(5)
    parts = ["a", "It", "É", "ß", "é", "≠", "7", "日", "'s", "'ll", " ", "\n", "\t ", "\x1c", "\x00", *"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
    found = packing.WordIds(tokenizer_path(PATH), known_words=500)
    for _ in range(20):
        texts = ["".join(draw.choices(parts, k=draw.randint(0, 60))) for _ in range(20)]
        ids = [np.frombuffer(i, "<u4").tolist() for i in found.of([t.encode() for t in texts])]
        assert ids == [found.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert found.of([]) == []
