import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from patronmap.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = "abcdefghij  \n\n\t▁éßüñ日本𝔘\x00 <s>0123.,!́ the ing﻿　"
SCHEMA = "doc_id bigint, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def data():
    with open(PATH, "rb") as file:
        return file.read()


def texts(n, seed=1):
    draw = random.Random(seed)
    yield from ["", " ", "  ", "\n", "▁", "a", "\x00", "x" * 5000, "ab " * 3000, "\n\n \n", "<s> </s> <unk> <0x41>", "日本" * 200]
    for i in range(n):
        alphabet = SIGNS if i % 3 else "aabbinthe r"
        yield "".join(draw.choice(alphabet) for _ in range(draw.randrange(90 if i % 5 else 900)))


def test_ids_texts_and_spans_equal_the_library(library, data):
    encoder = sentencepieces.Encoder(sentencepieces.PieceModel(data), limit=50)  # segments are forgotten often
    assert encoder.by_segment
    for text in texts(1500):
        ids, begins, ends = encoder.encode(text.encode())
        assert ids.tolist() == library.encode(text)
        assert encoder.model.decode(ids.tolist()) == library.decode(ids.tolist())
        raw = text.encode()
        assert b"".join(raw[b:e] for b, e in zip(begins, ends)) == raw
        whole = encoder.whole(text)
        assert [x.tolist() for x in (ids, begins, ends)] == [list(x) for x in whole]


def double_array(entries):
    """A double array of byte strings with numbers, a block of 256 places for every node."""
    children = {}
    for key in entries:
        for i in range(len(key)):
            children.setdefault(key[:i], set()).add(key[i])
    nodes = sorted({key[:i] for key in entries for i in range(len(key) + 1)}, key=len)
    units, place = [0] * (256 * (len(nodes) + 1)), {b"": 0}
    for number, node in enumerate(nodes, 1):
        base, at = 256 * number, place[node]
        assert (at ^ base) < 1 << 21
        units[at] |= (at ^ base) << 10
        if node in entries:
            units[at] |= 1 << 8
            units[base] = 1 << 31 | entries[node]
        for label in children.get(node, ()):
            place[node + bytes([label])] = base ^ label
            units[base ^ label] = label
    return struct.pack(f"<{len(units)}I", *units)


def with_map(data, rules, squeeze):
    """The model with a character map put behind its other parts."""
    replaced, entries = b"", {}
    for source, made in rules.items():
        entries[source.encode()] = len(replaced)
        replaced += made.encode() + b"\0"
    trie = double_array(entries)
    blob = struct.pack("<I", len(trie)) + trie + replaced

    def number(n):
        return bytes([n & 127 | 128]) + number(n >> 7) if n > 127 else bytes([n])

    spec = b"\x12" + number(len(blob)) + blob + b"\x18\x01" + b"\x20" + bytes([squeeze]) + b"\x28\x01"
    return data + b"\x1a" + number(len(spec)) + spec


RULES = {"ab": "x", "abc": "the", "é": "e", "日": " d ", "\n": " ", "\t": " ", "ß": "ss", "ﬁ": "fi", "g": "", "é": "é"}


@pytest.mark.parametrize("squeeze", [0, 1])
def test_character_map_takes_the_longest_entry(data, squeeze):
    made = with_map(data, RULES, squeeze)
    library = sentencepiece.SentencePieceProcessor(model_proto=made)
    encoder = sentencepieces.Encoder(sentencepieces.PieceModel(made))
    assert not encoder.by_segment
    for text in texts(400, seed=2):
        ids, begins, ends = encoder.encode(text.encode())
        assert ids.tolist() == library.encode(text), text
        assert encoder.model.decode(ids.tolist()) == library.decode(ids.tolist())
        assert all(0 <= b <= e <= len(text.encode()) for b, e in zip(begins, ends))
        assert (begins[1:] >= begins[:-1]).all() and (ends[1:] >= ends[:-1]).all()


def test_spans_point_at_the_source_of_a_replacement(data):
    model = sentencepieces.PieceModel(with_map(data, RULES, 0))
    text, begins, ends = model.normalised("zabcß")
    assert (text, begins, ends) == ("▁ztheſs".replace("ſ", "s"), [0, 0, 1, 1, 1, 4, 4], [0, 1, 4, 4, 4, 6, 6])


def brute(library, text):
    ids = library.encode(text or "")
    hexed = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
    return len(ids), *hexed


def test_tables_nulls_repeats_and_clashing_names(spark, library):
    given = [None, "", " ", "a b", "a b", "long " * 20000, *texts(60, seed=3)]
    rows = [(None if i == 3 else i // 2, t, "x", 1) for i, t in enumerate(given)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = sentencepieces.encode_digests(df, PATH).collect()
    key = lambda r: tuple(map(str, r))
    expected = [(r[0], *brute(library, r[1])) for r in rows]
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found], key=key) == sorted(expected, key=key)
    assert sum(r.span_bytes for r in found) == sum(len((t or "").encode()) for t in given)
    texts_back = sorted([(r[0], (r[1] or "").replace("▁", " ")) for r in rows], key=key)
    pieces = sentencepieces.encode(df, PATH)
    assert sorted([(r.doc_id, r.decoded) for r in pieces.collect()], key=key) == texts_back
    back = sentencepieces.decode(pieces, PATH)
    assert sorted([(r.doc_id, r.text) for r in back.collect()], key=key) == texts_back


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sentencepieces.encode_digests(empty, PATH).collect() == []
    assert sentencepieces.encode(empty, PATH).collect() == []
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<bigint>")
    assert [tuple(r) for r in sentencepieces.decode(none, PATH).sort("doc_id").collect()] == [(1, None), (2, "")]
