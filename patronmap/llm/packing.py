"""Best-fit packing of token sequences in bulk-synchronous rounds.

A document's ids are cut into pieces of at most `capacity`; pieces go whole into sequences of
that capacity, into as few as best-fit-decreasing needs.

Pieces of one length are interchangeable until ids are given out, and so are open sequences
with gaps of one size. Both are therefore held as runs of equal size with a count: at most
`capacity` runs of pieces, whatever the number of documents. A round sorts both by size; a
sweep finds for every run its successor, the smallest gap it fits into; where several runs
ask for one gap, the longer pieces go first, as many to a sequence as fit, and the others wait
for the next round; gaps shrink by what they took; new sequences are opened only for the
longest pieces that no gap takes. Rounds repeat until no piece is left. Their outcome is, for
every length, a list of rank intervals with a place for each rank.

What grows with the data is distributed: tokens are counted where the texts are, pieces are
ranked within their length in two levels (so a length that a third of all pieces have is
spread over many tasks), and every piece finds its place from its length and rank.

Tokens are made word by word, with the ids of words met before kept for reuse; the ids are
those of the tokenizer on the whole text.

Defined cases: a null or empty text has the end id alone; repeated rows are packed each;
null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import re
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronmap.llm.common import Batches, inputs, one_thread, scoped
from patronmap.storage import store

CAPACITY = 2048
END_ID = 0
KNOWN_WORDS = 150_000  # words whose ids a worker keeps, twice
LINE_WORDS, LINES = 500, 10  # new words to a line, and lines, that are tokenized together
BUCKET_ROWS = 500  # pieces of one length that are ranked together, on average
TEXT_BYTES = 1 << 21  # of texts that are tokenized together, or one longer text
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # letters with one lower-case form
# Signs after a word that the tokenizer cuts off: after ASCII letters and those of C3.
SIGNS = string.punctuation.encode()
LETTER = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])\Z")


# Tokens


class WordIds:
    """Ids of texts by a tokenizer of words, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and cuts between letters and the signs after them, so a
    text is cut there first, and a word met before keeps its ids. Words are kept in two
    generations of about `known_words`: once the newer is full it becomes the older, and words
    found there go into the newer again, so frequent ones stay.
    """

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        one_thread()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For words that normalising leaves as they are: cut at white space, then bytes as letters.
        self.splitter = Tokenizer.from_file(path)
        self.splitter.normalizer = None
        as_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.splitter.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_letters])
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.limit = known_words

    def _learn(self, words: list[bytes]) -> None:
        """Keep the ids of new words."""
        known, older = self.known, self.older
        cut, fresh = [], set()
        for word in words:
            core = word.rstrip(SIGNS)
            if len(core) < len(word) and (core[-1:].islower() or LETTER.search(core)):  # islower: ASCII
                tail = word[len(core) :]
                cut.append((word, core, tail))
                fresh.add(core)
                fresh.add(tail)
            else:
                fresh.add(word)
        fresh.difference_update(known)
        found = [(w, ids) for w in fresh if (ids := older.get(w)) is not None]
        known.update(found)
        fresh.difference_update([w for w, _ in found])
        latin = [w for w in fresh if w.isalpha() or LATIN.fullmatch(w)]  # isalpha: ASCII letters
        others = list(fresh.difference(latin))
        for start in range(0, len(latin), LINES * LINE_WORDS):
            some = latin[start : start + LINES * LINE_WORDS]
            lines = [some[s : s + LINE_WORDS] for s in range(0, len(some), LINE_WORDS)]
            texts = [b" ".join(line).decode().lower() for line in lines]
            for line, found in zip(lines, self.splitter.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(found.ids, dtype="<u4")
                edges = (4 * np.flatnonzero(self.is_end[ids]) + 4).tolist()
                raw = ids.tobytes()
                known.update(zip(line, [raw[a:b] for a, b in zip([0, *edges], edges)], strict=True))
        for start in range(0, len(others), LINES * LINE_WORDS):
            some = others[start : start + LINES * LINE_WORDS]
            for word, found in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                known[word] = np.array(found.ids, dtype="<u4").tobytes()
        known.update([(word, known[core] + known[tail]) for word, core, tail in cut])

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of a few texts; the words that are new in them are tokenized together."""
        if len(self.known) >= self.limit:
            self.known, self.older = {}, self.known
        lowered = pc.ascii_lower(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        split = pc.ascii_split_whitespace(lowered)  # at the white space that bytes.split() cuts at
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.known.get, words))
        if new := [i for i, ids in enumerate(known) if ids is None]:
            self._learn([words[i] for i in new])
            for i in new:
                known[i] = self.known[words[i]]
        ids = pa.array(known, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset) if len(ids) else np.zeros(1, np.int64)
        ends = ends[split.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) if b"<|" not in text else self._whole(text) for text, a, b in zip(texts, ends, ends[1:])]

    def _whole(self, text: bytes) -> bytes:
        """Of a text that may name special tokens, which are found before letters are lowered."""
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _in_portions(tokens: WordIds, texts: pa.Array):
    """Ids of every text, of a limited number of bytes at a time."""
    some, size = [], 0
    for text in texts:
        raw = text.as_py() or b""
        if some and size + len(raw) > TEXT_BYTES:
            yield from tokens.of(some)
            some, size = [], 0
        some.append(raw)
        size += len(raw)
    yield from tokens.of(some)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32; a row per piece."""
    fields = "piece int, start bigint, length bigint, ids_crc32 bigint"
    kind = docs.schema["doc_id"]
    from pyspark.sql import types as T

    out = T.StructType([kind, *T._parse_datatype_string(fields).fields])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Batches) -> Batches:
        tokens = _word_ids(tokenizer_path)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            texts = batch.column("text")
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            for row, ids in enumerate(_in_portions(tokens, texts)):
                ids += end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)),
                    pa.array(pieces, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, out)


# Rounds


@dataclass
class Placement:
    """Ranks from `rank` on: `each` pieces to a sequence, from `sequence` and `offset` on."""

    rank: int
    count: int
    sequence: int
    offset: int
    each: int


def plan_rounds(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[Placement]], int, int]:
    """(placements per length, sequences, rounds) for so many pieces of every length."""
    left = {n: c for n, c in counts.items() if c}
    ranks = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of (first sequence, sequences)
    placed: dict[int, list[Placement]] = {n: [] for n in left}
    sequences = rounds = 0

    def put(length: int, gap: int, first: int, available: int) -> int:
        """Fill sequences first..first+available, which have this gap; returns how many it used."""
        each = gap // length
        wanted = left[length]
        full = min(available, wanted // each)
        used = full
        if full:
            take(length, gap, first, full, each)
        if full < available and 0 < left[length] < each:
            take(length, gap, first + full, 1, left[length])
            used += 1
        return used

    def take(length: int, gap: int, first: int, n: int, each: int) -> None:
        placed[length].append(Placement(ranks[length], n * each, first, capacity - gap, each))
        ranks[length] += n * each
        left[length] -= n * each
        if rest := gap - each * length:
            fresh.setdefault(rest, []).append((first, n))

    while left:
        rounds += 1
        fresh: dict[int, list[tuple[int, int]]] = {}
        sizes, lengths = sorted(gaps), sorted(left, reverse=True)
        # Sweep: every length asks for its successor among the gaps.
        asks: dict[int, list[int]] = {}
        for length in lengths:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                asks.setdefault(sizes[at], []).append(length)
        if len(sizes) == 0 or lengths[0] > sizes[-1]:
            # The longest pieces fit nowhere: they open sequences, alone or in equal numbers.
            longest = lengths[0]
            each = capacity // longest
            needed = -(-left[longest] // each)
            used = put(longest, capacity, sequences, needed)
            sequences += used
        # A gap goes to the longest that ask for it. Shorter ones wait while a longer piece
        # still has none, which could leave them a better gap.
        waiting = max((n for n, c in left.items() if c), default=0)
        for size in sorted(asks, reverse=True):
            for length in asks[size]:
                if length != waiting or not left[length]:
                    continue
                runs = gaps.pop(size, [])
                while runs and left[length]:
                    first, available = runs.pop()
                    used = put(length, size, first, available)
                    if used < available:
                        runs.append((first + used, available - used))
                if runs:
                    gaps.setdefault(size, []).extend(runs)
                waiting = max((n for n, c in left.items() if c), default=0)
        for size, runs in fresh.items():
            gaps.setdefault(size, []).extend(runs)
        left = {n: c for n, c in left.items() if c}
    return placed, sequences, rounds


# Packing


@scoped("packed")
def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = inputs(docs, doc_id=id_col, text=text_col)
    pieces = store(token_pieces(rows, tokenizer_path, capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    placed, _, _ = plan_rounds(counts, capacity)

    order = ["doc_id", "piece", "start", "ids_crc32"]
    # A length has as many buckets as its pieces need; capacity rows at most.
    needed = [(length, -(-n // BUCKET_ROWS)) for length, n in counts.items()]
    buckets = F.broadcast(docs.sparkSession.createDataFrame(needed, "length bigint, buckets bigint"))
    numbered = pieces.join(buckets, "length").withColumn("bucket", F.pmod(F.xxhash64(*order), "buckets"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = numbered.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sums.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1
    ranked = numbered.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + inside)

    # The plan, by length: starts of its intervals and the place of each.
    plan = {
        length: tuple(np.array([getattr(p, f) for p in found], dtype=np.int64) for f in ("rank", "sequence", "offset", "each"))
        for length, found in placed.items()
    }
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    from pyspark.sql import types as T

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    fields = [ranked.schema[c] for c in kept] + T._parse_datatype_string("sequence_id bigint, offset bigint").fields

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows = lengths == length
                first, sequences, offsets, each = shared.value[int(length)]
                at = np.searchsorted(first, ranks[rows], side="right") - 1
                step = ranks[rows] - first[at]
                sequence[rows] = sequences[at] + step // each[at]
                offset[rows] = offsets[at] + step % each[at] * length
            arrays = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(run, T.StructType(fields))
