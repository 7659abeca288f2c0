"""WARC archives as a table of chunk rows.

A record is a head row (chunk -1: type, target, digest, length) followed by rows of at most
`chunk_bytes` payload bytes, numbered from 0. Writing and reading pass chunks on one by one,
so no task holds a whole record: the writer puts the length from the head before the payload
and streams the chunks into a gzip member of the record; the reader inflates archives in
blocks and gives chunk rows that carry the SHA-256 and the byte count of the payload so far.
The last chunk of a record thus has the digest of all of it.

Of records with equal payloads of at least `revisit_bytes`, the one with the smallest id is a
response and the others are revisits, which hold no payload, but the HTTP head with its
length, the digest and the id they refer to.

Archives are named after the content of their task and are renamed when complete, so a task
that runs again, after an executor was lost, replaces its own files. They go below the shared
folder by pyarrow.fs; the input is read by Spark alone.

Defined cases: a null payload is empty; a null id or target stays null; repeated rows are
records of their own, one of which is the response; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronmap.llm.common import Batches, inputs
from patronmap.storage import fresh_path, store

CHUNK_BYTES = 1 << 16
REVISIT_BYTES = 100
ARCHIVE_BYTES = 1 << 26
SALTS = 32  # parts of a group of equal payloads when its members look up their response
READ_BYTES = 1 << 16

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

HEAD = "record_id string, target_uri string, digest string, payload_bytes bigint"
CHUNKS = (
    "archive string, record_type string, record_id string, target_uri string, refers_to string, chunk bigint, "
    "data binary, bytes_so_far bigint, digest_so_far string, last boolean, payload_bytes bigint, payload_digest string"
)


def heads(records: DataFrame) -> DataFrame:
    """(record_id, target_uri, payload) -> a row per different record: copies, digest, response.

    `first` is the id of the response that holds the payload, where others share it.
    """
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    sized = records.select(
        "record_id", "order_id", "target_uri",
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes"),
    )
    own = sized.groupBy("record_id", "order_id", "target_uri", "digest", "payload_bytes").agg(F.count("*").alias("copies"))
    own = store(own, "heads")
    rank = F.struct(F.col("order_id").isNull().alias("last"), "order_id", F.coalesce("target_uri", F.lit("")).alias("uri"), "record_id")
    shared = (
        own.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min(rank).alias("first"), F.count("*").alias("members"))
        .where("members > 1")
        .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = own.withColumn("salt", F.pmod(F.xxhash64("record_id", "target_uri"), F.lit(SALTS)).cast("int"))
    found = salted.withColumn("rank", rank).join(shared, ["digest", "salt"], "left")
    other = F.col("first").isNotNull() & ~F.col("rank").eqNullSafe(F.col("first"))
    return found.select(
        "record_id", "target_uri", "digest", "payload_bytes", "copies",
        F.when(other, F.col("first.record_id")).otherwise(F.col("record_id")).alias("response"),
        other.alias("is_copy"),
    )


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Head rows and chunk rows of (record_id, order_id, target_uri, payload), in no order."""
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    head = heads(records).select(
        "record_id", "target_uri", "digest", F.lit(-1).cast("bigint").alias("chunk"),
        "payload_bytes", "copies", "response", "is_copy", F.lit(None).cast("binary").alias("data"),
    )
    cut = records.select("record_id", "target_uri", payload.alias("payload")).where(F.octet_length("payload") > 0)
    starts = F.sequence(F.lit(0), F.expr(f"(octet_length(payload) - 1) div {chunk_bytes}"))
    chunks = cut.select(
        "record_id", "target_uri", F.sha2("payload", 256).alias("digest"), "payload", F.explode(starts).alias("chunk")
    ).select(
        "record_id", "target_uri", "digest", F.col("chunk").cast("bigint").alias("chunk"),
        F.lit(None).cast("bigint").alias("payload_bytes"), F.lit(None).cast("bigint").alias("copies"),
        F.lit(None).cast("string").alias("response"), F.lit(None).cast("boolean").alias("is_copy"),
        F.expr(f"substring(payload, cast(chunk * {chunk_bytes} + 1 as int), {chunk_bytes})").alias("data"),
    )
    return head.unionByName(chunks)


def _line(name: bytes, value: str | bytes | None) -> bytes:
    if value is None:
        return b""
    return name + b": " + (value.encode() if isinstance(value, str) else value) + b"\r\n"


def _header(head: dict, revisit: bool) -> bytes:
    """The bytes before the payload: WARC fields and the HTTP head."""
    length = head["payload_bytes"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line(b"Content-Length", str(length)) + b"\r\n"
    coded = base64.b32encode(bytes.fromhex(head["digest"]))
    fields = _line(b"WARC-Type", "revisit" if revisit else "response")
    fields += _line(b"WARC-Record-ID", head["record_id"])
    fields += _line(b"WARC-Target-URI", head["target_uri"])
    fields += _line(b"WARC-Payload-Digest", b"sha256:" + coded)
    if revisit:
        fields += _line(b"WARC-Refers-To", head["response"]) + _line(b"WARC-Profile", PROFILE)
    fields += _line(b"Content-Type", "application/http; msgtype=response")
    fields += _line(b"Content-Length", str(len(http) + (0 if revisit else length)))
    return VERSION + b"\r\n" + fields + b"\r\n" + http


class _Archive:
    """Files of gzip members below a folder; a file gets its name when it is complete."""

    def __init__(self, folder: str, limit: int):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.limit, self.out, self.made = limit, None, []

    def open_record(self) -> None:
        if self.out is not None and self.out.tell() >= self.limit:
            self.close()
        if self.out is None:
            self.temporary = f"{self.folder}/.{uuid.uuid4().hex}.open"
            self.out, self.records, self.names = self.files.open_output_stream(self.temporary), 0, hashlib.sha256()
        self.gzip = zlib.compressobj(6, zlib.DEFLATED, 31)

    def write(self, data: bytes) -> None:
        self.out.write(self.gzip.compress(data))

    def end_record(self, name: bytes) -> None:
        self.write(END)
        self.out.write(self.gzip.flush())
        self.records += 1
        self.names.update(name)

    def close(self) -> None:
        if self.out is None:
            return
        size = self.out.tell()
        self.out.close()
        path = f"{self.folder}/part-{self.names.hexdigest()[:32]}.warc.gz"
        self.files.move(self.temporary, path)
        self.made.append((path, self.records, size))
        self.out = None


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of a chunk table; returns (path, records, bytes) of the archives.

    Rows are dealt by record and sorted by chunk, so a record streams through one task. Of
    repeated rows the payload is written once, the others revisit it, or are written again
    where they are too small for that.
    """
    keys = ["record_id", "target_uri", "digest"]
    dealt = chunks.repartition(*keys).sortWithinPartitions(*keys, "chunk")

    def run(batches: Batches) -> Batches:
        archive = _Archive(folder, archive_bytes)
        head: dict | None = None
        now: tuple | None = None
        expected, small = 0, b""

        def finish() -> None:
            if head is None:
                return
            name = repr((head["record_id"], head["target_uri"], head["digest"])).encode()
            big = head["payload_bytes"] >= REVISIT_BYTES
            if not head["is_copy"]:
                archive.end_record(name)
            for _ in range(head["copies"] - (0 if head["is_copy"] else 1)):
                archive.open_record()
                archive.write(_header(head, revisit=big))
                if not big:
                    archive.write(small)
                archive.end_record(name)

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["record_id"], row["target_uri"], row["digest"])
                if row["chunk"] < 0:
                    finish()
                    head, now, expected, small = row, key, 0, b""
                    if not row["is_copy"]:
                        archive.open_record()
                        archive.write(_header(row, revisit=False))
                elif head is None or key != now:
                    raise ValueError(f"chunk without a head: {key}")
                elif not head["is_copy"] and row["chunk"] == expected:  # else a repeated row's
                    archive.write(row["data"])
                    expected += 1
                    if head["payload_bytes"] < REVISIT_BYTES:
                        small = row["data"]
        finish()
        archive.close()
        paths, records, sizes = zip(*archive.made) if archive.made else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
            names=["path", "records", "bytes"],
        )

    return dealt.mapInArrow(run, "path string, records bigint, bytes bigint")


class _Inflated:
    """The inflated bytes of an archive, member by member."""

    def __init__(self, stream):
        self.stream, self.rest, self.buffer, self.inflate = stream, b"", b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            raw = self.rest or self.stream.read(READ_BYTES)
            self.rest = b""
            if not raw:
                return False
            data = self.inflate.decompress(raw, READ_BYTES)
            self.rest = self.inflate.unconsumed_tail
            if data:
                self.buffer += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with `mark`; None at the end."""
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        found, self.buffer = self.buffer[: at + len(mark)], self.buffer[at + len(mark) :]
        return found

    def take(self, most: int) -> bytes:
        """Between one and `most` bytes."""
        if not self.buffer and not self._more():
            raise ValueError("the archive ends inside a payload")
        found, self.buffer = self.buffer[:most], self.buffer[most:]
        return found

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            parts.append(self.take(n))
            n -= len(parts[-1])
        return b"".join(parts)


def _fields(block: bytes) -> dict[bytes, str]:
    pairs = (line.split(b":", 1) for line in block.split(b"\r\n")[1:] if b":" in line)
    return {name.strip().lower(): value.strip().decode() for name, value in pairs}


def _records(path: str, stream, chunk_bytes: int):
    """Chunk rows of an archive, in order."""
    source = _Inflated(stream)
    while (block := source.until(END)) is not None:
        if not block.startswith(VERSION):
            raise ValueError(f"no record begins here: {block[:40]!r} in {path}")
        fields = _fields(block)
        http = source.until(END)
        left = int(fields[b"content-length"]) - len(http)
        declared = int(_fields(http)[b"content-length"])
        coded = fields[b"warc-payload-digest"].split(":", 1)[1]
        row = {
            "archive": path, "record_type": fields[b"warc-type"], "record_id": fields.get(b"warc-record-id"),
            "target_uri": fields.get(b"warc-target-uri"), "refers_to": fields.get(b"warc-refers-to"),
            "payload_bytes": declared, "payload_digest": base64.b32decode(coded).hex(),
        }
        digest, done, chunk = hashlib.sha256(), 0, 0
        while True:
            data = source.exactly(min(chunk_bytes, left - done))
            digest.update(data)
            done += len(data)
            yield row | {
                "chunk": chunk, "data": data, "bytes_so_far": done, "digest_so_far": digest.copy().hexdigest(), "last": done == left,
            }
            chunk += 1
            if done == left:
                break
        if source.exactly(len(END)) != END:
            raise ValueError(f"a record of {path} is longer than it says")


def read_archives(spark: SparkSession, folder: str, chunk_bytes: int = CHUNK_BYTES, batch_bytes: int = 1 << 23) -> DataFrame:
    """Chunk rows of all archives of a folder.

    Spark lists the archives and deals them out by size; their content is read as a stream
    by the task, and batches end at `batch_bytes`.
    """
    files = (
        spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.warc.gz").load(folder).select("path")
    )
    from pyspark.sql import types as T

    names = [f.name for f in T._parse_datatype_string(CHUNKS).fields]
    kinds = {"chunk": pa.int64(), "data": pa.binary(), "bytes_so_far": pa.int64(), "last": pa.bool_(), "payload_bytes": pa.int64()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, inside = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
                rows, size = [], 0
                with files.open_input_stream(inside, compression=None) as stream:
                    for row in _records(path, stream, chunk_bytes):
                        rows.append(row)
                        size += len(row["data"]) + 500
                        if size >= batch_bytes:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, CHUNKS)


def record_digests(chunks: DataFrame) -> DataFrame:
    """A row per record read: what its last chunk and its head say, and whether they agree.

    A response's length and digest are those of the bytes read, a revisit's those it declares.
    """
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, F.col("payload_bytes")).otherwise(F.col("bytes_so_far"))
    digest = F.when(revisit, F.col("payload_digest")).otherwise(F.col("digest_so_far"))
    valid = (size == F.col("payload_bytes")) & (digest == F.col("payload_digest"))
    return chunks.where("last").select(
        "record_id", "target_uri", size.alias("payload_bytes"), digest.alias("payload_digest"),
        "record_type", "refers_to", valid.alias("valid"),
    )


def archive_pages(pages: DataFrame, folder: str, id_col: str, uri_col: str, payload_col: str) -> DataFrame:
    """Write a record per row; returns the manifest of archives, computed.

    Record ids are `<urn:record:ID>`, missing where the id is null.
    """
    rows = inputs(pages, order_id=id_col, target_uri=uri_col, payload=payload_col)
    uri = F.regexp_replace("target_uri", r"[\r\n]", " ")
    named = F.concat(F.lit("<urn:record:"), F.col("order_id").cast("string"), F.lit(">"))
    rows = rows.withColumns({"record_id": named, "target_uri": uri})
    return store(write_archives(chunk_table(rows), folder), "archives")


def record_key(record_id, kind: str):
    """The id inside `<urn:record:ID>`."""
    return F.regexp_extract(record_id, "^<urn:record:(.*)>$", 1).cast(kind)


def round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the rows' payloads to archives, read these back, and describe every record."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    make_folder(folder)
    archive_pages(pages, folder, id_col, uri_col, payload_col)
    kind = pages.schema[id_col].dataType.simpleString()
    found = record_digests(read_archives(spark, folder))
    return found.select(
        record_key(F.col("record_id"), kind).alias(id_col),
        "payload_bytes", "payload_digest", "record_type",
        record_key(F.col("refers_to"), kind).alias("refers_to"), "valid",
    )


def make_folder(folder: str) -> None:
    files, inside = fs.FileSystem.from_uri(folder)
    files.create_dir(inside, recursive=True)
