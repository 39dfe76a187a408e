"""WARC archives: writer, normaliser of monolithic gzip files, reader by sidecar index.

``write`` makes one monolithic .warc.gz (a single gzip stream over all records, as naive tools leave them) per partition.
``normalise`` inflates each such file once, as a stream, and writes every record again as a gzip member of its own
(so that a record can be read by its offset) plus a sidecar index with a line for each record:
offset, length, type, record id, archive.  ``read`` takes the index as a text table and fetches each member by offset.

Records with equal payloads of at least ``least`` bytes: the one with the largest page_id is a response, the others
are revisits of it.  Only the payload digests are grouped, and only digests that occur more than once are joined back.

Files go to a folder that driver and executors share, through pyarrow's file systems (local, HDFS, S3, GCS by the
folder's scheme).  Each task writes under a name of its own attempt and then moves the file into place, so a
task that is run again or twice leaves one whole file.  Memory: one block of a record at a time while
normalising, one record while writing and reading.

Defined results: null html is an empty payload; null url has no target header; rows without page_id have a record id without number
and read back as null, and revisit like others; rows that repeat the largest page_id are all responses;
an empty table writes no record and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 18


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record; a revisit keeps length and digest of its payload in the header."""
    body = HTTP + (payload if refers_to is None else b"")
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + _record_id(page_id), b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m.group()[0], url.encode()))
    if refers_to is not None:
        head += [b"WARC-Refers-To: " + _record_id(refers_to), b"WARC-Profile: " + PROFILE]
    head += [b"WARC-Payload-Digest: sha1:" + digest(payload).encode(), b"X-Payload-Length: %d" % len(payload), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def _record_id(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id)


def _page_id(value: bytes) -> int | None:
    number = value.strip(b"<>").rpartition(b":")[2]
    return int(number) if number else None


def header(block: bytes) -> dict[bytes, bytes]:
    """Lower-cased names to values of a record's header."""
    lines = block.split(b"\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines) if k}


def _place(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Moved:
    """An output file that appears under its name when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _place(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.path = f"{root}/{name}", f"{root}/_{name}.{uuid.uuid4().hex}"
        self.size = 0

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.path, compression=None)
        return self

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            try:
                self.fs.move(self.path, self.final)
            except OSError:  # some stores don't move onto a file, here that of an earlier attempt of this task
                self.fs.delete_file(self.final)
                self.fs.move(self.path, self.final)
        else:
            self.fs.delete_file(self.path)


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to (null for a response)."""
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.when(F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= least, sha).alias("sha"))
    shared = pages.where("sha IS NOT NULL").groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last")
    joined = pages.join(shared, "sha", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Write (page_id, url, html, refers_to) as monolithic archives; (archive, records) for each that holds any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"archive-{TaskContext.get().partitionId():06d}.warc.gz"
        n, gz = 0, zlib.compressobj(level, zlib.DEFLATED, 31)
        with _Moved(folder, name) as out:
            for b in batches:
                for page_id, url, html, refers_to in zip(*(b.column(i) for i in range(4))):
                    out.write(gz.compress(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), date)))
                    n += 1
            out.write(gz.flush())
        yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n]}, pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    return records.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records long").where("records > 0")


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """Blocks of at most ``BLOCK`` bytes of a gzip file of one or more members."""
    d = zlib.decompressobj(31)
    data = b""
    while data or (data := read(BLOCK)):
        if d.eof:
            d = zlib.decompressobj(31)
        if block := d.decompress(data, BLOCK):
            yield block
        data = d.unused_data if d.eof else d.unconsumed_tail
    while not d.eof and (block := d.decompress(b"", BLOCK)):
        yield block
    if not d.eof:
        raise ValueError("the gzip stream ends early")


def record_blocks(blocks: Iterator[bytes]) -> Iterator[tuple[dict[bytes, bytes] | None, bytes]]:
    """(header, its bytes), then (None, body block) ..., for each record; the body's last block ends the record."""
    held = b""

    def more() -> bool:
        nonlocal held
        block = next(blocks, None)
        held += block or b""
        return block is not None

    while True:
        while not held.strip(b"\r\n") and more():
            held = held.lstrip(b"\r\n")
        if not held.strip(b"\r\n"):
            return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record's header ends early")
        raw, held = held[:end + 4], held[end + 4:]
        fields = header(raw)
        yield fields, raw
        left = int(fields[b"content-length"]) + 4
        while left:
            if not held and not more():
                raise ValueError("a record's body ends early")
            part, held = held[:left], held[left:]
            left -= len(part)
            yield None, part


def normalise(archives: DataFrame, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite every archive of ``archives`` record by record; (archive, records, bytes), one row each."""

    def one(name: str) -> tuple[str, int, int]:
        fs, root = _place(source)
        n, gz, start = 0, None, 0
        with fs.open_input_stream(f"{root}/{name}", compression=None) as file, _Moved(target, name) as out, _Moved(f"{target}/index", f"{name}.idx") as index:
            line = b""

            def close() -> None:
                nonlocal n
                if gz:
                    out.write(gz.flush())
                    index.write(b"%d\t%d\t%s\n" % (start, out.size - start, line))
                    n += 1

            for fields, part in record_blocks(inflated(file.read)):
                if fields is not None:
                    close()
                    start, gz = out.size, zlib.compressobj(level, zlib.DEFLATED, 31)
                    line = b"\t".join((fields[b"warc-type"], fields[b"warc-record-id"], name.encode()))
                out.write(gz.compress(part))
            close()
            return name, n, out.size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name in f["archive"]:
                yield pd.DataFrame([one(name)], columns=["archive", "records", "bytes"])

    return archives.select("archive").mapInPandas(run, "archive string, records long, bytes long")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every indexed record; a response's payload is
    checked against its digest."""
    lines = spark.read.text(f"{folder}/index").select(F.split("value", "\t").alias("v"))
    at = lines.select(F.col("v")[0].cast("long").alias("offset"), F.col("v")[1].cast("long").alias("length"), F.col("v")[4].alias("archive"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _place(folder)
        file, opened = None, None
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            rows = []
            for offset, length, name in zip(*(c.to_pylist() for c in b.columns)):
                if name != opened:
                    file, opened = fs.open_input_file(f"{root}/{name}"), name
                file.seek(offset)
                raw, _, body = zlib.decompress(file.read(length), 31).partition(b"\r\n\r\n")
                h = header(raw)
                kind, stated = h[b"warc-type"].decode(), h[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
                size = int(h[b"x-payload-length"])
                if kind == "response":
                    payload = body[:int(h[b"content-length"])].partition(b"\r\n\r\n")[2]
                    if (len(payload), digest(payload)) != (size, stated):
                        raise ValueError(f"{name} at {offset}: the payload doesn't match its digest")
                url = h.get(b"warc-target-uri")
                rows.append((_page_id(h[b"warc-record-id"]), url and url.decode(), size, stated, kind, _page_id(h[b"warc-refers-to"]) if b"warc-refers-to" in h else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    return at.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise these, and read the result back."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    written = stored(write(roles(pages, least), f"{folder}/monolithic"))
    n = max(1, written.count())
    done = stored(normalise(written.repartition(n, "archive"), f"{folder}/monolithic", f"{folder}/normalised"))
    if done.isEmpty():
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(spark, f"{folder}/normalised")
