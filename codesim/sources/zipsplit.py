"""Split archive source: zip files of any size, read by offset ranges, many tasks to an archive.

``binaryFile`` gives an archive as one row, which ends at 2 GB and keeps an archive in one task.  Here Spark's text reader cuts
the archives at the signature of a local entry header (its ``lineSep``), so that archives are split like any
text file, by whatever file system Spark reads, and a row is what stands between two signatures: as a rule one entry.

1. ``blocks``: one pass adds up the lengths of the rows of each file block, which places every row in its archive, and keeps the
   archive's end, where its central directory stands.
2. ``directory``: the standard library reads each archive's central directory from that end: name, offset, size and checksum of each
   entry.  Names are filtered, and of a repeated name the last entry is chosen, before any entry is read.
3. ``entries``: a second pass takes the rows at the chosen offsets, which are broadcast while they are few.  Data that holds the signature
   itself (an archive stored within an archive) comes in several rows; those are found by the range of
   their entry and put together again.  An entry is inflated and its checksum tested in the task that has its bytes.

Archives whose directory can't be read that way (truncated, no zip at all, the signature inside the directory) go to
``archives.expand`` as a whole, which either reads them or says what is wrong, so that both sources give the same rows and errors.
An entry itself must fit in a row.
"""

from __future__ import annotations

import bz2
import io
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import Params
from ..session import materialise
from . import archives

#: Fixed values of the format: signatures of a local entry, a directory entry and the directory's end; size of a local header.
LOCAL, CENTRAL, END = "PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
HEADER = 30
#: Entries are found by ranges of this many bytes.
RANGE = 1 << 20
#: Places of signatures are written in lists of at most this many.
MANY = 100_000


def _rows(spark: SparkSession, path) -> DataFrame:
    """(file, size, block, data): what stands between two signatures, in order within a block."""
    read = (spark.read.format("text").option("lineSep", LOCAL).option("pathGlobFilter", "*.[zZ][iI][pP]")
            .option("recursiveFileLookup", "true").load(path))
    meta = F.col("_metadata")
    return read.select(meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"),
                       F.col("value").cast("binary").alias("data"))


def listed(spark: SparkSession, path) -> DataFrame:
    """(path, file): every archive by its path and by the name that the text reader gives it; no content is read."""
    return archives.list_archives(spark, path).select("path", F.col("_metadata")["file_path"].alias("file"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rel``, where the row's data starts within the rows of its block, and ``extra``, the length of name and extra field
    if the row starts with a whole local header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rel = None, 0
        for b in batches:
            out, extra = [], []
            for file, block, cell in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if (file, block) != at:
                    at, rel = (file, block), 0
                data = cell.as_buffer()
                out.append(rel)
                extra.append(sum(struct.unpack_from("<HH", data, HEADER - 4 - len(LOCAL))) if data.size >= HEADER - len(LOCAL) else None)
                rel += data.size + len(LOCAL)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64()), pa.array(extra, pa.int64())], ["file", "size", "block", "data", "rel", "extra"])

    return rows.mapInArrow(run, "file string, size long, block long, data binary, rel long, extra long")


def blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From one pass over ``rows``: (file, block, base), where the rows of each block start in their archive; (file, at), the
    signatures' places; (file, size, start, tail), the end of each archive, from the first directory signature in its last row with
    a directory's end."""
    kinds = {"file": pa.string(), "size": pa.int64(), "block": pa.int64(), "length": pa.int64(), "start": pa.int64(), "tail": pa.binary(), "rels": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rel, last = None, 0, {}

        def out(length: int) -> pa.RecordBatch:
            cells = {**last, "length": length}
            last.update(start=None, tail=None, rels=[])
            return pa.RecordBatch.from_arrays([pa.array([cells[k]], t) for k, t in kinds.items()], list(kinds))

        for b in batches:
            for file, size, block, cell in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                if (file, block) != at:
                    if last:
                        yield out(rel)
                    at, rel = (file, block), 0
                    last = {"file": file, "size": size, "block": block, "start": None, "tail": None, "rels": []}
                elif len(last["rels"]) >= MANY:
                    yield out(0)
                data = cell.as_py()
                if END in data:
                    first = data.find(CENTRAL)
                    first = data.find(END) if first < 0 else first
                    last.update(start=rel + first, tail=data[first:])
                last["rels"].append(rel)
                rel += len(data) + len(LOCAL)
        if last:
            yield out(rel)

    found, _ = materialise(rows.mapInArrow(run, "file string, size long, block long, length long, start long, tail binary, rels array<bigint>"), "zip_blocks")
    order = Window.partitionBy("file").orderBy("block")  # a row per block
    sums = found.groupBy("file", "block").agg(F.sum("length").alias("length"))
    base, _ = materialise(sums.select("file", "block", (F.sum("length").over(order) - F.col("length")).alias("base")), "zip_bases")
    starts = found.select("file", "block", F.explode("rels").alias("rel")).join(base, ["file", "block"]).select("file", (F.col("base") + F.col("rel") - len(LOCAL)).alias("at"))
    ends = found.where("tail IS NOT NULL").join(base, ["file", "block"]).withColumn("start", F.col("base") + F.col("start"))
    ends = ends.groupBy("file").agg(F.max_by(F.struct("size", "start", "tail"), "start").alias("e"))
    return base, starts, ends.select("file", "e.size", "e.start", "e.tail")


class _End(io.RawIOBase):
    """An archive of which only the end can be read."""

    def __init__(self, size: int, start: int, tail: bytes):
        self.size, self.start, self.tail, self.at = size, start, tail, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = (0, self.at, self.size)[whence] + offset
        if self.at < 0:
            raise OSError("before the start")
        return self.at

    def read(self, n: int = -1) -> bytes:
        """Before the end there are zeros, which no signature is."""
        n = max(0, min(self.size - self.at, self.size if n < 0 else n))
        missing = max(0, min(n, self.start - self.at))
        a = max(0, self.at - self.start)
        self.at += n
        return bytes(missing) + self.tail[a:a + n - missing]


def directory(ends: DataFrame, params: Params, all_entries: bool) -> DataFrame:
    """(file, raw_path, entry_ordinal, at, length, method, crc, flags): the admitted entries of each archive whose directory can be read; one
    row with null raw_path and ordinal -1 stands for an archive that can be."""
    chosen = archives.chooser(params, all_entries)
    names = ["file", "raw_path", "entry_ordinal", "at", "length", "method", "crc", "flags"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, size, start, tail in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    with zipfile.ZipFile(_End(size, start, tail)) as zf:
                        if zf.start_dir < start and zf.infolist():
                            continue  # the directory begins before what is held of it
                        rows = [(file, None, -1, None, None, None, None, None)]
                        rows += [(file, x.filename, i, x.header_offset, x.compress_size, x.compress_type, x.CRC, x.flag_bits) for i, x in chosen(zf)]
                except archives.BROKEN:
                    continue
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 10_000]), kinds)], names)

    return ends.select("file", "size", "start", "tail").mapInArrow(
        run, "file string, raw_path string, entry_ordinal int, at long, length long, method int, crc long, flags int")


def inflate(data: bytes, method: int) -> bytes:
    if method == zipfile.ZIP_STORED:
        return data
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(data, -15)
    if method == zipfile.ZIP_BZIP2:
        return bz2.decompress(data)
    if method == zipfile.ZIP_LZMA:
        # two bytes version, two bytes size of the properties: lc, lp and pb in one byte, then the dictionary size
        size = struct.unpack_from("<H", data, 2)[0]
        packed, dictionary = struct.unpack_from("<BI", data, 4)
        filters = [{"id": lzma.FILTER_LZMA1, "dict_size": dictionary, "lc": packed % 9, "lp": packed // 9 % 5, "pb": packed // 45}]
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data[4 + size:])
    raise NotImplementedError("That compression method is not supported")


def entry_data(raw: bytes, name: str, length: int, method: int, crc: int, flags: int) -> bytes:
    """The content of an entry from its bytes, which start behind its signature."""
    if flags & 1:
        raise RuntimeError(f"File {name!r} is encrypted, password required for extraction")
    name_size, extra = struct.unpack_from("<HH", raw, HEADER - 4 - len(LOCAL))
    start = HEADER - len(LOCAL) + name_size + extra
    if start + length > len(raw):
        raise EOFError(f"{name!r} ends early")
    try:
        data = inflate(raw[start:start + length], method)
    except lzma.LZMAError as e:
        raise zipfile.BadZipFile(str(e)) from e
    if zlib.crc32(data) != crc:
        raise zipfile.BadZipFile(f"Bad CRC-32 for file {name!r}")
    return data


def _expanded(found: DataFrame, failfast: bool, keep_data: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "raw_path", "data", "entry_ordinal", "error"]
        for b in batches:
            for i in range(b.num_rows):
                file, raw_path, ordinal, length, method, crc, flags, raw = (c[i].as_py() for c in b.columns)
                data = error = None
                try:
                    data = entry_data(LOCAL.encode().join(raw), raw_path, length, method, crc, flags)
                except (*archives.BROKEN, struct.error) as e:
                    if failfast:
                        raise
                    error = f"{type(e).__name__}: {e}"
                cells = (file, raw_path, data if keep_data else None, ordinal, error)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, (pa.string(), pa.string(), pa.binary(), pa.int32(), pa.string()))], names)

    cols = ("file", "raw_path", "entry_ordinal", "length", "method", "crc", "flags", "raw")
    return found.select(*cols).mapInArrow(run, "file string, raw_path string, data binary, entry_ordinal int, error string")


def _found(rows: DataFrame, base: DataFrame, starts: DataFrame, wanted: DataFrame, params: Params) -> DataFrame:
    """``wanted`` entries with ``raw``, their bytes behind the signature, in parts between which the signature stands.  Which rows
    an entry has is told by narrow rows first; bytes are shuffled once, to those, and once more where an entry has several rows."""

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= params.broadcast_rows else df

    keys = ["file", "at", "raw_path", "entry_ordinal", "length", "method", "crc", "flags"]
    at = placed(rows).join(near(base), ["file", "block"]).withColumn("at", F.col("base") + F.col("rel") - len(LOCAL))
    need = F.col("length") + F.col("extra") + HEADER - len(LOCAL)
    end = F.col("at") + F.col("length") + F.coalesce("extra", F.lit(2 * 65535)) + HEADER
    heads = at.select("file", "at", "extra", F.octet_length("data").alias("held")).join(near(wanted), ["file", "at"])
    heads, _ = materialise(heads.select(*keys, F.coalesce(F.col("held") >= need, F.lit(False)).alias("whole"), end.alias("end")), "zip_heads")
    at = at.where("at >= 0").select("file", F.col("at").alias("from"), "data")
    whole = at.join(near(heads.where("whole").select(F.col("at").alias("from"), *keys)), ["file", "from"]).select(*keys, F.array("data").alias("raw"))
    # the signature stands in the entry itself: all rows in its range, found by stretches of the archive
    spans = heads.where(~F.col("whole")).withColumn("range", F.explode(F.sequence(F.expr(f"at div {RANGE}"), F.expr(f"(end - 1) div {RANGE}"))))
    inner = starts.where("at >= 0").select("file", F.col("at").alias("from"), F.expr(f"at div {RANGE}").alias("range"))
    inner, _ = materialise(inner.join(near(spans), ["file", "range"]).where("from >= at AND from < end").select("from", *keys), "zip_parts")
    joined = at.join(near(inner), ["file", "from"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("from", "data"))).alias("p"))
    return whole.unionByName(joined.select(*keys, F.transform("p", lambda x: x["data"]).alias("raw")))


def expand(spark: SparkSession, path, params: Params = Params(), mode: str = "FAILFAST", all_entries: bool = False) -> DataFrame:
    """As ``archives.expand`` over ``archives.list_archives``: (path, raw_path, data, entry_ordinal, error)."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode must be FAILFAST or PERMISSIVE")
    names = listed(spark, path)
    near = F.broadcast if names.count() <= params.broadcast_rows else lambda df: df
    rows = _rows(spark, path)
    base, starts, ends = blocks(rows)
    known, _ = materialise(directory(ends, params, all_entries), "zip_directory")
    # an entry that is not where the directory says leaves its archive to the whole reader
    lost = known.where("entry_ordinal >= 0").join(starts, ["file", "at"], "left_anti").select("file").distinct()
    known, _ = materialise(known.join(lost, "file", "left_anti"), "zip_readable")
    found = _found(rows, base, starts, known.where("entry_ordinal >= 0"), params)
    bad = None
    if mode == "PERMISSIVE":  # reads every archive through once
        wrong = _expanded(found, False, False).where("error IS NOT NULL")
        bad, _ = materialise(wrong.groupBy("file").agg(F.min_by("error", "entry_ordinal").alias("error")), "zip_bad")
        found = found.join(bad, "file", "left_anti")
    out = _expanded(found, True, True).join(near(names), "file").select("path", "raw_path", "data", "entry_ordinal", "error")
    if bad is not None:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("raw_path", "string"), ("data", "binary"), ("entry_ordinal", "int"))]
        out = out.unionByName(bad.join(names, "file").select("path", *empty, "error"))
    # paths alone, all of which Spark's file index holds on the driver anyway
    rest = [r["path"] for r in names.join(known.select("file"), "file", "left_anti").select("path").toLocalIterator()]
    if rest:
        exact = [re.sub(r"([][{}*?\\])", r"\\\1", p) for p in rest]
        out = out.unionByName(archives.expand(archives.list_archives(spark, exact), params, mode, all_entries))
    return out
