"""Files with quoted line breaks against Python's csv module."""

from __future__ import annotations

import csv
import io
import random

import pyarrow as pa
import pytest

from patronmap.sources import delimited, mapping, quoted


def write(folder, files):
    for name, data in files.items():
        (folder / name).write_bytes(data)
    return str(folder)


def expected(files, sep):
    out, header = [], None
    for name in sorted(files):
        text = files[name].decode()
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if "".join(r).strip() or len(r) > 1]
        header = header or rows[0]
        out += [tuple((x or None) for x in r) for r in rows[1:]]
    return header, sorted(out, key=str)


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def table(rows, seed, end):
    draw = random.Random(seed)
    text = io.StringIO(newline="")
    out = csv.writer(text, lineterminator=end)
    out.writerow(["id", "remark", "n"])
    for i in range(rows):
        parts = draw.choices(["a", " b", ",", ";", '"', '""', "\n", "\r\n", "\r", "é", "x" * 40, '5" pipe', "\n\n"], k=draw.randrange(0, 9))
        out.writerow([i, "t" + "".join(parts), draw.choice(["1", "", "zwei\ndrei"])])
    return text.getvalue().encode()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_csv_module(spark, tmp_path, small_ranges, end):
    files = {"a.csv": table(120, 1, end), "b.csv": table(40, 2, end), "c.csv": table(1, 3, end)}
    path = write(tmp_path, files)
    found = delimited.scan_delimited(spark, path, ",")
    header, rows = expected(files, ",")
    assert found.columns == header
    assert sorted([tuple(r) for r in found.collect()], key=str) == rows
    states = quoted.range_states(spark, path, ",").collect()
    assert len(states) > 10 and any(s.inside for s in states)


def test_a_field_over_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i} with, commas" for i in range(400))
    files = {"a.csv": f'id,remark\n1,"{long}"\n2,"{long}"\n3,x\n'.encode()}
    found = delimited.scan_delimited(spark, write(tmp_path, files), ",")
    assert sorted(tuple(r) for r in found.collect()) == [("1", long), ("2", long), ("3", "x")]


def test_a_header_with_a_line_break_and_blank_lines(spark, tmp_path):
    files = {"a.csv": b'\n"the\nid";n\n\n1;"a\nb"\n  \n2;c'}
    found = delimited.scan_delimited(spark, write(tmp_path, files), ";")
    assert found.columns == ["the\nid", "n"]
    assert sorted(tuple(r) for r in found.collect()) == [("1", "a\nb"), ("2", "c")]


def test_quotes_inside_plain_fields_open_nothing(spark, tmp_path):
    files = {"a.csv": b'id,remark\n1,5" pipe\n2,6" and 7" pipe\n'}
    path = write(tmp_path, files)
    assert quoted.scan_quoted(spark, path, ",", {}) is None
    found = delimited.scan_delimited(spark, path, ",")
    assert sorted(tuple(r) for r in found.collect()) == [("1", '5" pipe'), ("2", '6" and 7" pipe')]


def test_nulls_empty_texts_and_a_quote_never_closed(spark, tmp_path):
    files = {"a.csv": b'id,a,b\n1,,""\n2,"x\ny",z\n3,"open, to\nthe end\n'}
    rows = delimited.scan_delimited(spark, write(tmp_path, files), ",").sort("id").collect()
    plain = delimited.scan_delimited(spark, write(tmp_path / "..", {"plain.csv": b'id,a,b\n1,,""\n'}) + "/plain.csv", ",").first()
    assert [tuple(r) for r in rows[:2]] == [tuple(plain), ("2", "x\ny", "z")]
    assert len(rows) == 3 and rows[2].id == "3"


def test_no_lines(spark, tmp_path):
    files = {"a.csv": b"id,a\n", "b.csv": b""}
    path = write(tmp_path, files)
    assert delimited.scan_delimited(spark, path, ",").collect() == []


def test_written_and_read_back_as_transactions(spark, tmp_path):
    rows = [(f'desc "{i}"\nline, two', "2024-01-02", float(i)) for i in range(50)] + [(None, None, None), ("e", "x", 1.5)]
    df = spark.createDataFrame(rows, "Description string, day string, total double")
    path = str(tmp_path / "out")
    delimited.write_delimited(df, path, sep="|", multi_line=True)
    names = mapping.ColumnMapping("Description", "day", "total")
    found = delimited.read_transactions(spark, path, names)
    got = sorted([(r[0], r[1] is not None, r[2]) for r in found.collect()], key=str)
    assert got == sorted([(c, d == "2024-01-02", a) for c, d, a in rows], key=str)


def test_the_state_of_lines():
    for line, outside, inside in [
        (b"a,b", False, True), (b'a,"b', True, False), (b'"', True, False), (b'""', False, True), (b'"""', True, False),
        (b'a"b,c', False, False), (b'a,"b"c"d,e', False, False), (b'x","y', True, True), (b'","', False, True), (b"", False, True),
    ]:
        assert (quoted.line_state(line, b",", False), quoted.line_state(line, b",", True)) == (outside, inside), line


def test_lines_of_a_batch_together_equal_one_by_one():
    """The effects, states and records of random lines, in batches of several sizes."""
    draw = random.Random(8)
    for _ in range(60):
        lines = ["".join(draw.choices(["a", "é\U0001f600", ";", '"', '""', " ", "\t"], k=draw.randrange(7))) + draw.choice(["", "", "\r"]) for _ in range(80)]
        outside, inside, _ = quoted._effects(b";")(pa.array(lines))
        for start in (False, True):
            state, states = start, []
            for line in lines:
                state = quoted.line_state(line.removesuffix("\r").encode(), b";", state)
                states.append(state)
            assert quoted._states(outside, inside, start).tolist() == states
            batches = [pa.RecordBatch.from_pydict({"file": ["f"] * len(p), "block": [0] * len(p), "inside": [start] * len(p), "value": p})
                       for p in (lines[:1], lines[1:30], lines[30:31], lines[31:])]
            found = pa.Table.from_batches(list(quoted._records(b";")(iter(batches)))).to_pylist()
            records, parts, state = [], "", start
            for line, after in zip(lines, states):
                if after:
                    parts += line + "\n"
                else:
                    records.append(parts + line.removesuffix("\r"))
                    parts = ""
            assert found[-1]["lines"] == 80 and found[-1]["kind"] is None
            pending = [parts] if parts else []
            carried = records[:1] if start else []
            expected = carried + [r for r in records[len(carried):] if r.strip("".join(map(chr, range(33))))] + pending
            assert [r["text"] for r in found[:-1]] == expected


def test_alike_lines_are_worked_out_once(monkeypatch):
    calls, state = [], quoted.line_state
    monkeypatch.setattr(quoted, "line_state", lambda *given: calls.append(1) or state(*given))
    lines = [f'"order ""{i}"";' if i % 2 else f'line, {i}";2024-01-0{i % 9};{i}' for i in range(5000)]
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * 5000, "block": [0] * 5000, "inside": [False] * 5000, "value": lines})
    list(quoted._records(b";")(iter([batch])))
    list(quoted._summaries(b";")(iter([batch.select(["file", "block", "value"]).rename_columns(["file", "block", "marked"])])))
    assert len(calls) < 50
