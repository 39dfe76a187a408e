"""Archive source: zip files of submissions (and of the template).

``binaryFile`` lists and reads the archives; ``mapInPandas`` expands each
archive into one row per admitted entry inside the task that read it, so a
repeated entry name (the last one wins) never needs a shuffle.  Entry-name
filters (directories, excluded components, extension) run before an entry's
bytes are read; entries leave the task in chunks of bounded size.  Archives are
numbered by their paths alone and the numbers come to the entries by broadcast, so bytes
stay in the task that read them.  Bytes become text on the JVM side (``make_valid_utf8``:
invalid sequences become U+FFFD, like Python's ``errors='replace'``).

A broken archive (bad structure, checksum, encryption, unknown or damaged compression) fails the
job (``mode='FAILFAST'``) or, with ``mode='PERMISSIVE'``, is reported in ``rejects`` and
contributes no files: such a run reads every archive through once before it yields an entry.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.decode import decoded
from ..params import Params
from ..session import materialise

ENTRY_SCHEMA = "path string, raw_path string, data binary, entry_ordinal int, error string"
BROKEN = (zipfile.BadZipFile, EOFError, OSError, ValueError, RuntimeError, NotImplementedError, zlib.error)
#: Entries are yielded when this many bytes, or rows, are gathered.
CHUNK_BYTES, CHUNK_ROWS = 32 << 20, 1000


@dataclass
class ArchiveInput:
    files: DataFrame      # submission_id, submission, raw_path, content
    roster: DataFrame     # submission_id, submission (every archive, even without files)
    rejects: DataFrame    # submission_id, submission, error


def list_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(archive path, content) of every ``*.zip`` (any case) under ``path``."""
    return (spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.[zZ][iI][pP]")
            .option("recursiveFileLookup", "true")
            .load(path))


def archive_stem(path_col) -> F.Column:
    """Archive file name without its last suffix (``b.tar.zip`` -> ``b.tar``)."""
    return F.regexp_extract(path_col, r"([^/]+?)(\.[^./]*)?$", 1)


def numbered(paths: DataFrame) -> DataFrame:
    """(path, submission_id, submission): dense 0-based ids in sorted path order (the input ordinal).  The sorted
    paths are written once with their partition; a rank is the partition's offset plus the rank within it."""
    ordered, _ = materialise(paths.select("path").orderBy("path").withColumn("_p", F.spark_partition_id()), "archive_paths")
    sizes = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row per partition
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("path"))
    return ordered.withColumn("_r", rank).join(before, "_p").select(
        "path", (F.col("_before") + F.col("_r") - 1).cast("long").alias("submission_id"), archive_stem(F.col("path")).alias("submission"))


def chooser(params: Params, all_entries: bool):
    """The (ordinal, info) of an open archive's admitted entries; of a repeated name the last, unless ``all_entries``."""
    allowed_set, excluded_set = set(params.allowed_exts), set(params.exclude_dirs)

    def admit(info: zipfile.ZipInfo) -> bool:
        name = info.filename
        if info.is_dir() or any(part.lower() in excluded_set for part in name.split("/")):
            return False
        return name.split(".")[-1].lower() in allowed_set

    def chosen(zf: zipfile.ZipFile) -> list:
        found = [(i, info) for i, info in enumerate(zf.infolist()) if admit(info)]
        return found if all_entries else list({info.filename: (i, info) for i, info in found}.values())

    return chosen


def _expander(params: Params, failfast: bool, all_entries: bool):
    chosen = chooser(params, all_entries)

    def problem(blob: bytes) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(blob)) as zf:
                for _, info in chosen(zf):
                    with zf.open(info) as f:
                        while f.read(1 << 20):
                            pass
        except BROKEN as e:
            return f"{type(e).__name__}: {e}"
        return None

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["path", "raw_path", "data", "entry_ordinal", "error"])

    def expand(batches):
        for pdf in batches:
            for path, blob in zip(pdf["path"], pdf["content"]):
                error = None if failfast else problem(blob)
                if error:
                    yield frame([(path, None, None, None, error)])
                    continue
                out, size = [], 0
                with zipfile.ZipFile(io.BytesIO(blob)) as zf:
                    for i, info in chosen(zf):
                        data = zf.read(info)
                        out.append((path, info.filename, data, i, None))
                        size += len(data)
                        if size >= CHUNK_BYTES or len(out) >= CHUNK_ROWS:
                            yield frame(out)
                            out, size = [], 0
                if out:
                    yield frame(out)

    return expand


def expand(archives: DataFrame, params: Params = Params(), mode: str = "FAILFAST", all_entries: bool = False) -> DataFrame:
    """(path, content) to (path, raw_path, data, entry_ordinal, error), one row per admitted entry; of entries with
    the same name the last one, unless ``all_entries``."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode must be FAILFAST or PERMISSIVE")
    return archives.select("path", "content").mapInPandas(
        _expander(params, mode == "FAILFAST", all_entries), ENTRY_SCHEMA)


def text_of(data, charset: str = "utf8") -> F.Column:
    """Text of a binary column: UTF-8 with U+FFFD for what is invalid, or, with ``charset='detect'``, in the character set its bytes tell."""
    if charset == "detect":
        return decoded(data)
    if charset != "utf8":
        raise ValueError("charset must be utf8 or detect")
    return F.make_valid_utf8(F.col(data).cast("string"))


def _entries(spark: SparkSession, path, params: Params, mode: str, all_entries: bool, split: bool) -> DataFrame:
    if split:
        from . import zipsplit

        return zipsplit.expand(spark, path, params, mode, all_entries)
    return expand(list_archives(spark, path), params, mode, all_entries)


def read_archives(spark: SparkSession, path: str | list[str], params: Params = Params(),
                  mode: str = "FAILFAST", split: bool = False, charset: str = "utf8") -> ArchiveInput:
    """Submission archives -> files table (admitted entries, last one wins).  ``split`` reads them by offset ranges
    (``zipsplit``): for archives over 2 GB, or few and large.  ``charset``: see ``text_of``."""
    names = numbered(list_archives(spark, path).select("path"))
    known = F.broadcast(names) if names.count() <= params.broadcast_rows else names
    entries = _entries(spark, path, params, mode, False, split).join(known, "path")
    files = entries.where(F.col("error").isNull()).select("submission_id", "submission", "raw_path", text_of("data", charset).alias("content"))
    rejects = entries.where(F.col("error").isNotNull()).select("submission_id", "submission", "error")
    return ArchiveInput(files, names.select("submission_id", "submission"), rejects)


def read_template(spark: SparkSession, path: str | list[str] | None, params: Params = Params(),
                  mode: str = "FAILFAST", split: bool = False, charset: str = "utf8") -> DataFrame | None:
    """Template archive(s) -> (raw_path, content) of all admitted entries, repeated names included; ``None`` stays ``None``."""
    if path is None:
        return None
    entries = _entries(spark, path, params, mode, True, split)
    return entries.where(F.col("error").isNull()).select("raw_path", text_of("data", charset).alias("content"))
