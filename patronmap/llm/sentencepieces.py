"""SentencePiece encoding that keeps offsets, and decoding.

A model file holds pieces with scores, a compiled character map and flags. A text is
normalised by that map: at every place the longest source string that the map holds is
replaced, a character outside the map stays, spaces become U+2581, one of which is put in
front. Every normalised byte remembers where its source begins and ends. The normalised text
is merged pair by pair, the best score first and the leftmost of equals; characters without a
piece become one piece per byte. Every piece is projected to the bytes of the original text
that it came from: from the first byte of the source of its first character to the last byte
of the source of its last. Bytes of one character that the map left alone have one byte each.

No merge crosses a place where the two characters next to it stand side by side in no piece.
Texts are cut at such places before spaces, around line breaks and between letters and signs,
and a segment met before keeps its pieces, so work follows the different segments. Spark spreads the texts; a worker
keeps a bounded number of segments.

Defined cases: a null text is an empty one; an empty text has no pieces; repeated rows are
encoded each; an empty table gives no rows; ids may be null or of any type.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import string
import struct
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from patronmap.llm.common import Batches, Texts, inputs

SPACE = "▁"
RAW_SPACE = SPACE.encode()
# Texts are also cut between these letters and these signs, if no piece holds both side by side.
LETTERS = string.ascii_letters + "".join(c for c in map(chr, range(0xC0, 0x100)) if c.isalpha())
SIGNS = string.punctuation
KNOWN_SEGMENTS = 300_000  # segments whose pieces a worker keeps, twice
SHORT = 100  # symbols up to which the best pair is sought by looking at all
NO_PIECE = float("inf")
# Fixed values of the model file's format: types of pieces, and BPE among the kinds of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


# The model file


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a message: an int, or the bytes of anything else."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled map: a double array of source strings, and their replacements."""

    def __init__(self, blob: bytes = b""):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes of the source, replacement) of the longest entry that starts here."""
        units, found = self.units, None
        unit = units[0]
        node = self._offset(unit)
        for place in range(at, len(source)):
            node ^= source[place]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != source[place]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:  # an entry ends here
                found = place + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.replacements[start : self.replacements.index(b"\0", start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class PieceModel:
    """A model of byte pair pieces."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        self.fallback, self.dummy_prefix, self.squeeze = False, True, True
        self.map, kind_of_model, suffix = CharacterMap(), 1, False
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
                kind_of_model = trainer.get(3, 1)
                self.fallback, suffix = bool(trainer.get(35, 0)), bool(trainer.get(24, 0))
            elif field == 3:
                normalizer = dict(_fields(value))
                self.map = CharacterMap(normalizer.get(2, b""))
                self.dummy_prefix = bool(normalizer.get(3, 1))
                self.squeeze = bool(normalizer.get(4, 1))
        if kind_of_model != BPE or suffix or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("only models of byte pair pieces, without user-defined or unused pieces")
        self.unknown = kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        self.normal = set(self.ids.values())
        self.ranks = {p: -scores[i] for p, i in self.ids.items()}  # the best score first
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        # Per id: its text as bytes, and its decimals with a comma.
        self.surfaces = [
            b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else self.byte_of.get(i) or p.replace(SPACE, " ").encode()
            for i, (p, k) in enumerate(zip(self.pieces, kinds))
        ]
        self.decimals = [b"%d," % i for i in range(len(kinds))]
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Merges never cross a pair of characters that no piece holds.
        self.cut_at_spaces = not any(p[1] == SPACE != p[0] for p in pairs)
        self.cut_at_lines = not any("\n" in p for p in pairs)
        self.cut_signs = "".join(c for c in SIGNS if not any(p[1] == c and p[0] in LETTERS for p in pairs))

    def normalised(self, text: str) -> tuple[str, list[int], list[int]]:
        """(normalised text, begin, end): the source bytes of every normalised character."""
        source, out, begins, ends = text.encode(), [], [], []
        at, after_space = 0, self.squeeze
        while at < len(source):
            made, size = self._next(source, at)
            if not out and self.squeeze and made == " ":
                at += size  # spaces in front go, also where nothing follows
                continue
            if not out and self.dummy_prefix and not begins:
                out, begins, ends = [SPACE], [at], [at]
            kept = made.lstrip(" ") if after_space else made
            if kept:
                out += kept.replace(" ", SPACE)
                begins += [at] * len(kept)
                ends += [at + size] * len(kept)
                after_space = self.squeeze and kept.endswith(" ")
            at += size
        while self.squeeze and out and out[-1] == SPACE:
            del out[-1], begins[-1], ends[-1]
        return "".join(out), begins, ends

    def _next(self, source: bytes, at: int) -> tuple[str, int]:
        """(replacement, bytes of the source): the longest entry of the map, or one character as it is."""
        if self.map and (entry := self.map.longest(source, at)):
            return entry[1].decode(), entry[0]
        first = source[at]
        size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return source[at : at + size].decode(), size

    def merged(self, text: str) -> list[str]:
        """The pieces of a normalised text: the best pair is merged until no pair is a piece."""
        rank, parts = self.ranks.get, list(text)
        if len(parts) > SHORT:
            return self._merged_long(parts)
        ranks = [rank(a + b, NO_PIECE) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NO_PIECE:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], NO_PIECE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], NO_PIECE)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same with a heap; merged symbols are linked, stale pairs are passed over."""
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < n:
                pair = parts[left] + parts[after[left]]
                if (rank := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (rank, left, pair))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, pair = heapq.heappop(heap)
            if not parts[left] or after[left] >= n or parts[left] + parts[after[left]] != pair:
                continue
            right = after[left]
            parts[left], parts[right] = pair, ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return [p for p in parts if p]

    def pieces_of(self, text: str, begins: list[int], ends: list[int]) -> tuple[list[int], list[int], list[int]]:
        """(ids, begin, end) of the pieces of a normalised text with these source bytes per character."""
        ids, first, last = [], [], []
        at = 0
        for piece in self.merged(text):
            begin, end = begins[at], ends[at + len(piece) - 1]
            at += len(piece)
            if (known := self.ids.get(piece)) is not None:
                ids.append(known)
                first.append(begin)
                last.append(end)
                continue
            raw = piece.encode()
            if not self.fallback:
                if ids and ids[-1] == self.unknown:
                    last[-1] = end  # neighbours without a piece are one
                    continue
                raw, found = b"", [self.unknown]
            else:
                found = [self.bytes[b] for b in raw]
            ids += found
            own = len(raw) == end - begin
            first += [begin + i * own for i in range(len(found))]
            last += [begin + i + 1 if own else end for i in range(len(found))]
        return ids, first, last

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD.

        As long as there is no text, a piece loses one space in front; only the first such
        space goes if the model keeps extra spaces.
        """
        parts, stripping = [], self.dummy_prefix or self.squeeze
        for i in ids:
            part = self.surfaces[i]
            if stripping and part:
                if i in self.normal and part.startswith(b" "):
                    part, stripping = part[1:], self.squeeze
                stripping = stripping and not part
            parts.append(part)
        return b"".join(parts).decode(errors="replace")


# Texts


class Segment(NamedTuple):
    """Pieces of a segment: as decimals with a comma behind each, ids, bytes of each, their text."""

    decimals: bytes
    ids: bytes
    sizes: bytes
    text: bytes


class Encoder:
    """Encodes texts segment by segment, with the segments met last kept."""

    def __init__(self, model: PieceModel, limit: int = KNOWN_SEGMENTS):
        self.model, self.limit = model, limit
        self.recent: dict[bytes, Segment] = {}
        self.older: dict[bytes, Segment] = {}
        # Segments of the source can be normalised one by one if the map changes nothing.
        self.by_segment = (
            not model.map and not model.squeeze and model.dummy_prefix and model.cut_at_spaces and model.fallback
            and max(map(len, model.surfaces)) < 256
        )
        self.pattern = self._pattern()

    def _pattern(self) -> re.Pattern:
        """Line breaks; or spaces with the characters after them, up to a space, line break or sign after a letter."""
        line = rb"\n" if self.model.cut_at_lines else b""
        other = rb"[^ " + line + b"]"
        found = rb" *" + other + rb"+"
        if signs := re.escape(self.model.cut_signs).encode():
            letter = rb"(?:(?<=[A-Za-z])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))"  # LETTERS as bytes
            plain = rb" *[^ " + line + signs + rb"]+(?:" + letter + rb"(?=[" + signs + rb"])|[" + signs + rb"]" + other + rb"*)?"
            found = plain + rb"| *[" + signs + rb"]" + other + rb"*"
        return re.compile((line + b"+|" if line else b"") + found + rb"| +")

    def _learn(self, segment: bytes) -> Segment:
        """Pieces of a segment that is not among the recent ones; kept until as many others came twice."""
        if (known := self.older.get(segment)) is None:
            model, ids = self.model, []
            for piece in model.merged(segment.decode().replace(" ", SPACE)):
                if (one := model.ids.get(piece)) is not None:
                    ids.append(one)
                else:
                    ids += [model.bytes[b] for b in piece.encode()]
            texts = [model.surfaces[i] for i in ids]
            decimals = b"".join([model.decimals[i] for i in ids])
            known = Segment(decimals, array("i", ids).tobytes(), bytes(map(len, texts)), b"".join(texts))
        if len(self.recent) >= self.limit:
            self.older, self.recent = self.recent, {}
        self.recent[segment] = known
        return known

    def parts(self, text: bytes) -> list[Segment]:
        """The segments of a text with a space in front."""
        if not text:
            return []
        known, learn = self.recent.get, self._learn
        found = []
        for segment in self.pattern.findall(b" " + text.replace(RAW_SPACE, b" ")):
            if (part := known(segment)) is None:
                part = learn(segment)
                known = self.recent.get
            found.append(part)
        return found

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, end): pieces and the bytes of the text that they stand for."""
        if not self.by_segment or RAW_SPACE in text:
            return tuple(np.array(x, np.int32) for x in self.whole(text.decode()))
        parts = self.parts(text)
        ids = np.frombuffer(b"".join([p.ids for p in parts]), np.int32)
        return ids, *self.spans(parts)

    @staticmethod
    def spans(parts: list[Segment]) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end): pieces lie one behind another; the space put in front is no byte of the text."""
        sizes = np.frombuffer(b"".join([p.sizes for p in parts]), np.uint8)
        ends = np.cumsum(sizes, dtype=np.int32) - 1
        return np.maximum(ends - sizes, 0), ends

    def whole(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """The same without segments of the source: for maps that change texts."""
        normal, begins, ends = self.model.normalised(text)
        ids, first, last = [], [], []
        cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.model.cut_at_spaces else re.compile(".+", re.DOTALL)
        for found in cut.finditer(normal):
            some = self.model.pieces_of(found[0], begins[found.start() : found.end()], ends[found.start() : found.end()])
            ids += some[0]
            first += some[1]
            last += some[2]
        return ids, first, last

    def digests(self, text: bytes) -> tuple[int, str, str, int]:
        """(number of ids, SHA-256 of the decimals, SHA-256 of the decoded text, bytes in spans)."""
        if self.by_segment and RAW_SPACE not in text:
            parts = self.parts(text)
            decimals = b"".join([p.decimals for p in parts])[:-1]
            decoded = b"".join([p.text for p in parts])[1:]  # without the space put in front
            begins, ends = self.spans(parts)
            n = len(ends)
        else:
            ids, begins, ends = self.encode(text)
            decimals, n = ",".join(map(str, ids.tolist())).encode(), len(ids)
            decoded = self.model.decode(ids.tolist()).encode()
        covered = int(np.sum(ends - begins, dtype=np.int64))
        return n, hashlib.sha256(decimals).hexdigest(), hashlib.sha256(decoded).hexdigest(), covered


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    with open(path, "rb") as file:  # installed on every executor, not part of the data
        return Encoder(PieceModel(file.read()))


# Tables


def _rows(docs: DataFrame, id_col: str, text_col: str, schema: str, work) -> DataFrame:
    rows = inputs(docs, doc_id=id_col, text=text_col)
    out = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(schema).fields])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts, ids = Texts(batch.column("text")), batch.column("doc_id")
            for start in range(0, len(texts), Texts.ROWS):
                made = work([t or b"" for t in texts[start : start + Texts.ROWS]])
                yield pa.RecordBatch.from_arrays([ids[start : start + Texts.ROWS], *made.values()], names=["doc_id", *made])

    return rows.mapInArrow(run, out)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends, decoded): pieces, their bytes in the original, and the text of the ids."""

    def work(texts: list[bytes]) -> dict[str, pa.Array]:
        encoder = _encoder(model_path)
        found = [encoder.encode(t) for t in texts]
        offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found]), pa.int32())) for i in range(3)]
        decoded = pa.array([encoder.model.decode(f[0].tolist()) for f in found], pa.string())
        return {"ids": lists[0], "begins": lists[1], "ends": lists[2], "decoded": decoded}

    return _rows(docs, id_col, text_col, "ids array<int>, begins array<int>, ends array<int>, decoded string", work)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes): digests of what `encode` returns.

    Ids and texts stay where they are made; only digests leave a task.
    """

    def work(texts: list[bytes]) -> dict[str, pa.Array]:
        encoder = _encoder(model_path)
        n, ids, decoded, spans = zip(*(encoder.digests(t) for t in texts))
        return {
            "n_tokens": pa.array(n, pa.int64()),
            "ids_sha256": pa.array(ids, pa.string()),
            "decoded_sha256": pa.array(decoded, pa.string()),
            "span_bytes": pa.array(spans, pa.int64()),
        }

    return _rows(docs, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, span_bytes bigint", work)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with ids; null ids give a null text."""
    from pyspark.sql import functions as F

    given = inputs(rows, doc_id=id_col, ids=ids_col).withColumn("ids", F.col("ids").cast("array<int>"))
    out = T.StructType([given.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            model = _encoder(model_path).model
            texts = [None if ids is None else model.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return given.mapInArrow(run, out)
