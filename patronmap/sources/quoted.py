"""Delimited text whose quoted fields hold line breaks, read by many tasks.

A line either starts outside quotes or inside a quoted field that an earlier line opened; what
it does to that state depends on the line alone. A first pass reduces every byte range of a
file to two answers: the state at its end for either state at its start. A window over the
ranges of a file (a row per range) then gives the true state at every start: a range whose
answers are the same fixes the state, one that swaps them counts, and the state is the last
fixed one changed by the swaps since. If no range holds a line that leaves a quote open, lines
are records and Spark reads them as they are.

Otherwise a second pass joins the lines of a range into records. What a record has in other
ranges comes as fragments, at most two a range, which are put together by range. Records are
stored as text once, in the shared folder, and parsed by `from_csv` with the options of a plain
scan, so both ways give the same columns and nulls.

What a line does to the state follows from its quotes, separators and carriage returns, so in both
passes it is worked out once for each way these follow each other, and looked up for the lines of a
batch together. Only ranges with carriage returns inside lines are read line by line.

A quote opens a field only at its start; inside, two quotes stand for one; after the closing
quote all text up to the separator belongs to the field. Records end at a line feed, carriage
return or both, outside quotes. Blank records are skipped, the first record of every file is
its header. A quote that is never closed takes the rest of its file into one record.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronmap.storage import scratch, store

QUOTE = b'"'
WHOLE, HEAD, MIDDLE, TAIL = range(4)
BLANKS = bytes(range(33))  # what a blank line may hold
SPLITS = "spark.sql.files.minPartitionNum"


def line_state(line: bytes, sep: bytes, inside: bool) -> bool:
    """Whether a quoted field is open behind a line, if one was or wasn't before it."""
    at = 0
    while True:
        if not inside:
            if line.startswith(QUOTE, at):
                at += 1
            else:
                at = line.find(sep, at) + len(sep)
                if at < len(sep):
                    return False
                continue
        at = line.find(QUOTE, at)
        if at < 0:
            return True
        inside = line.startswith(QUOTE, at + 1)  # two quotes are one
        at += 2 if inside else 1
        if not inside:
            at = line.find(sep, at) + len(sep)
            if at < len(sep):
                return False


def sublines(line: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(text, line break) of the parts between carriage returns of a line that a line feed ends."""
    parts = line.split(b"\r")
    ends = [b"\r"] * (len(parts) - 1) + [b"\n"]
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
        ends[-2:] = [b"\r\n"]
    return zip(parts, ends)


# Shapes of lines whose effects a task remembers, at most.
REMEMBERED = 10_000


def _effects(sep: bytes):
    """Of lines, from their texts: the states behind each for both before it, and how often it leaves one open."""
    known: dict[str | None, tuple[bool, bool, int]] = {}
    # Only a run of other characters, whose length does not matter, stands between the ones kept.
    plain = f'[^"\\r{re.escape(sep.decode())}]+' if len(sep) == 1 else None

    def effect(shape: str | None) -> tuple[bool, bool, int]:
        states, opened = [False, True], 0
        if shape is not None:
            for part, end in sublines(shape.encode()):
                after = [line_state(part, sep, s) for s in (False, True)]
                opened += after[0] or end == b"\r"
                states = [after[s] for s in states]
        return states[0], states[1], opened

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shapes = texts if plain is None else pa.compute.replace_substring_regex(texts, plain, "x")
        coded = shapes.dictionary_encode(null_encoding="encode")
        if len(known) > REMEMBERED:
            known.clear()
        found = []
        for shape in coded.dictionary.to_pylist():
            if shape not in known:
                known[shape] = effect(shape)
            found.append(known[shape])
        outside, inside, opened = (np.array(c) for c in zip(*found))
        at = coded.indices.to_numpy()
        return outside[at], inside[at], opened[at]

    return run


def _states(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """The states behind lines that come after `start`, from their effects."""
    swaps = np.cumsum(outside & ~inside)
    fixed = np.maximum.accumulate(np.where(outside == inside, np.arange(len(outside)), -1))
    known = fixed >= 0
    since = swaps - np.where(known, swaps[fixed], 0)
    return (np.where(known, outside[fixed], start) + since) % 2 == 1


def _runs(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[tuple, bool, pa.Array]]:
    """(file, block and more, whether these begin, texts) of consecutive lines of a range."""
    before = None
    for batch in batches:
        keys = [c for c in batch.schema.names if c != text]
        columns = [batch.column(c) for c in keys]
        edges = [0]
        if batch.num_rows > 1:
            differs = pa.compute.not_equal(columns[1].slice(1), columns[1].slice(0, batch.num_rows - 1))
            differs = pa.compute.or_(differs, pa.compute.not_equal(columns[0].slice(1), columns[0].slice(0, batch.num_rows - 1)))
            edges += [i + 1 for i in pa.compute.indices_nonzero(differs).to_pylist()]
        for start, end in zip(edges, [*edges[1:], batch.num_rows]):
            if end > start:
                key = tuple(c[start].as_py() for c in columns)
                yield key, key != before, batch.column(text).slice(start, end - start)
                before = key


def _summaries(sep: bytes):
    """What every range does to the state: `after_outside`, `after_inside`, and how many lines it has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lines, states, open_lines = None, 0, [False, True], 0
        effects = _effects(sep)

        def out() -> pa.RecordBatch:
            columns = [[key[0]], [key[1]], [lines], [states[0]], [states[1]], [open_lines]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=SUMMARY)

        for mine, new, texts in _runs(batches, "marked"):
            if new:
                if key is not None:
                    yield out()
                key, lines, states, open_lines = mine, 0, [False, True], 0
            lines += len(texts)
            outside, inside, opened = effects(texts)
            open_lines += int(opened.sum())
            states = [bool(_states(outside, inside, state)[-1]) for state in states]
        if key is not None:
            yield out()

    return run


SUMMARY = ["file", "block", "lines", "after_outside", "after_inside", "open_lines"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of every byte range, in order within it."""
    at = "_metadata.file_path AS file", "_metadata.file_block_start AS block"
    return spark.read.text(path, lineSep="\n").selectExpr(*at, "value")


def range_states(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Per byte range: `SUMMARY`, and `inside`: whether it starts inside quotes."""
    value = F.col("value")
    returned = F.instr(value, "\r").between(1, F.length(value) - 1)
    marked = F.when(value.contains('"') | returned, value).alias("marked")
    schema = "file string, block bigint, lines bigint, after_outside boolean, after_inside boolean, open_lines bigint"
    ranges = _lines(spark, path).select("file", "block", marked).mapInArrow(_summaries(sep.encode()), schema)
    ranges = store(ranges, "ranges")
    # The state before a range is the last fixed one, changed by every swap since.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.col("after_outside") & ~F.col("after_inside")
    fixes = F.col("after_outside") == F.col("after_inside")
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ranges.withColumn("swaps", F.sum(swaps.cast("long")).over(so_far))
    fixed = F.when(fixes, F.col("after_outside").cast("long") + F.col("swaps"))
    counted = counted.withColumn("fixed", F.last(fixed, ignorenulls=True).over(earlier))
    before = F.coalesce(F.lag("swaps").over(Window.partitionBy("file").orderBy("block")), F.lit(0))
    return counted.withColumn("inside", (F.coalesce("fixed", F.lit(0)) + before) % 2 == 1).select(*SUMMARY, "inside")


def _records(sep: bytes):
    """Lines of ranges as records and fragments of records."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, lines, inside, carried, first = None, 0, False, False, False
        parts: list[bytes] = []  # of the record that is being read, with their line breaks
        effects = _effects(sep)

        def end_range() -> None:
            if parts:
                out.append((key[0], key[1], MIDDLE if carried else HEAD, first, b"".join(parts), 0))
            out.append((key[0], key[1], None, False, None, lines))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            arrays[4] = arrays[4].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, names=RECORD)

        for mine, new, texts in _runs(batches, "value"):
            if new:
                if key is not None:
                    end_range()
                key, lines, parts = mine, 0, []
                inside = carried = bool(mine[2])
                first = mine[1] == 0  # the next record is the header of its file
            lines += len(texts)
            if not pa.compute.any(pa.compute.match_substring_regex(texts, RETURNED)).as_py():
                after = _states(*effects(texts)[:2], inside)
                ends = np.flatnonzero(~after) + 1
                done = int(ends[-1]) if len(ends) else 0
                if done:
                    whole = _joined(texts.slice(0, done), ends)
                    kinds = np.full(len(ends), WHOLE, np.int32)
                    if parts:
                        start = b"".join(parts).decode()
                        whole = pa.concat_arrays([pa.array([start + whole[0].as_py()], pa.string()), whole.slice(1)])
                    kinds[0] = TAIL if carried else WHOLE
                    kept = pa.compute.match_substring_regex(whole, NOT_BLANK).to_numpy(zero_copy_only=False) | (kinds == TAIL)
                    whole, kinds = whole.filter(pa.array(kept)), kinds[kept]
                    heads = np.zeros(len(kinds), bool)
                    heads[:1] = first and not carried
                    first = first and not len(kinds)
                    columns = [pa.array([v] * len(kinds), k) for v, k in zip(key[:2], (pa.string(), pa.int64()))]
                    columns += [pa.array(kinds), pa.array(heads), whole, pa.array(np.zeros(len(kinds), np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=RECORD)
                    carried, parts = False, []
                if done < len(texts):
                    parts.append(_joined(texts.slice(done), np.array([len(texts) - done]), strip=False)[0].as_py().encode() + b"\n")
                inside = bool(after[-1])
                continue
            for text in texts.cast(pa.binary()).to_pylist():
                pieces = ((text.removesuffix(b"\r"), b"\n"),) if QUOTE not in text and b"\r" not in text[:-1] and not inside else sublines(text)
                for part, end in pieces:
                    inside = line_state(part, sep, inside) if inside or QUOTE in part else False
                    if inside:
                        parts += part, end
                        continue
                    whole = b"".join([*parts, part]) if parts else part
                    if carried or whole.strip(BLANKS):
                        out.append((key[0], key[1], TAIL if carried else WHOLE, first and not carried, whole, 0))
                        first = False
                    carried, parts = False, []
            if len(out) > 2000:
                yield batch_of()
                out = []
        if key is not None:
            end_range()
        if out:
            yield batch_of()

    return run


RECORD = ["file", "block", "kind", "first", "text", "lines"]
RETURNED = r"\r(?s:.)"  # a carriage return inside a line
NOT_BLANK = r"[^\x00-\x20]"


def _joined(texts: pa.Array, ends: np.ndarray, strip: bool = True) -> pa.Array:
    """Consecutive lines up to each of `ends` as one text, without the carriage return behind it if `strip`."""
    places = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    whole = pa.compute.binary_join(pa.ListArray.from_arrays(places, texts), "\n")
    return pa.compute.replace_substring_regex(whole, r"\r\z", "") if strip else whole


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Files are cut alike in both passes, whatever executors come or go between them."""
    before = spark.conf.get(SPLITS, None)
    spark.conf.set(SPLITS, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SPLITS)
        else:
            spark.conf.set(SPLITS, before)


def _stitched(spark: SparkSession, path: str, sep: str, states: DataFrame) -> DataFrame:
    """(first, text): all records; `first` marks headers."""
    from patronmap.operators.segments import broadcast_if_small

    started = broadcast_if_small(states.where("inside").select("file", "block", "inside"))
    lines = _lines(spark, path).join(started, ["file", "block"], "left")
    schema = "file string, block bigint, kind int, first boolean, text string, lines bigint"
    ordered = lines.select("file", "block", F.coalesce("inside", F.lit(False)).alias("inside"), "value")
    rows = store(ordered.mapInArrow(_records(sep.encode()), schema), "records")
    counts = rows.where("kind IS NULL").select("file", "block", F.col("lines").alias("found"))
    if not counts.join(states.select("file", "block", "lines"), ["file", "block"], "full").where("NOT found <=> lines").isEmpty():
        raise RuntimeError(f"{path} changed while it was read")
    place = F.when(F.col("kind") == HEAD, 1).otherwise(0)  # a range ends a record before it begins one
    order = Window.partitionBy("file").orderBy("block", place)
    pieces = rows.where(F.col("kind") != WHOLE).withColumn("place", place)
    pieces = pieces.withColumn("record", F.sum("place").over(order))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "place", "text"))), lambda x: x["text"]), "")
    merged = pieces.groupBy("file", "record").agg(F.max("first").alias("first"), joined.alias("text"))
    return rows.where(F.col("kind") == WHOLE).select("first", "text").unionByName(merged.select("first", "text"))


def scan_quoted(spark: SparkSession, path: str, sep: str, options: dict[str, str]) -> DataFrame | None:
    """All records of files with quoted line breaks, all columns as text; None if no line leaves a quote open.

    `options` are those of a plain scan, header apart.
    """
    with scratch(spark) as scope, _same_splits(spark):
        states = range_states(spark, path, sep)
        if not states.agg(F.max("open_lines")).first()[0]:
            return None
        records = _stitched(spark, path, sep, states)
        scope.release(next(p for p in scope.paths if "/records-" in p))
        header = records.where("first").agg(F.min("text")).first()[0]
    if header is None:
        return None
    names = spark.read.csv(spark.sparkContext.parallelize([header], 1), header=True, multiLine=True, **options).columns
    columns = ", ".join("`" + n.replace("`", "``") + "` STRING" for n in names)
    return records.where("NOT first").select(F.from_csv("text", columns, options).alias("row")).select("row.*")
