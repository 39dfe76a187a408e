"""A code-like corpus derived from the ``documents`` table.

Each document becomes one source file of a submission, so the whole analysis
runs over the whole table and its work grows with it.  The layout (fixed,
also written independently in the DuckDB oracle):

- submission_id = doc_id % 20, submission = source, slot = doc_id div 20
- ext: 'txt' when slot % 25 = 24, else en -> py, de -> java, fr -> js, other -> sql
- raw_path = source/<dir>/f<slot>.<ext>, dir = node_modules (slot % 10 = 9),
  Build (slot % 10 = 8), else src
- content carries per-document noise only inside comments and strings, so
  copies of a text still normalise to equal content
- submissions src0 and src1 form the template; src2 ... src19 are analysed
- rows with slot % 7 = 3 get a second archive entry (entry_ordinal 1) with one
  more line, for the duplicate-entry rule
"""

from __future__ import annotations

import io
import warnings
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATE_IDS = (0, 1)
N_SUBMISSIONS = 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def to_deal(spark: SparkSession, sf_dir: str) -> int:
    """Partitions to deal the documents out to: 0 where no task reads more than twice a core's share of them, as that shuffles all texts.  A file
    that is a single row group can't be split by the reader and is dealt out."""
    cores = spark.sparkContext.defaultParallelism
    read = documents(spark, sf_dir).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    most, rows = read.agg(F.max("n"), F.sum("n")).first()
    return cores if (most or 0) * cores > 2 * (rows or 0) else 0


def code_files(spark: SparkSession, sf_dir: str, with_revisions: bool = False, n_submissions: int = N_SUBMISSIONS) -> DataFrame:
    """``n_submissions`` other than 20 (a multiple of it) gives smaller submissions, the template still being the first two."""
    d = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    slot = F.expr(f"doc_id div {n_submissions}")
    ext = (F.when(slot % 25 == 24, "txt").when(F.col("lang") == "en", "py")
           .when(F.col("lang") == "de", "java").when(F.col("lang") == "fr", "js")
           .otherwise("sql"))
    folder = (F.when(slot % 10 == 9, "node_modules").when(slot % 10 == 8, "Build")
              .otherwise("src"))
    doc = F.col("doc_id").cast("string")
    py_content = F.concat(F.lit('"""'), F.col("source"), F.lit('"""\n# note '), doc,
                          F.lit("\ntitle = '"), F.col("lang"), F.lit("'\n"),
                          F.col("text"), F.lit("\n"))
    c_content = F.concat(F.lit("/* "), F.col("source"), F.lit(" */\n// note "), doc,
                         F.lit('\nString s = "a\\"b'), doc, F.lit('";\nchar c = \'x\';\n'),
                         F.col("text"), F.lit("\n"))
    files = (d.withColumn("slot", slot).withColumn("ext", ext)
             .select((F.col("doc_id") % n_submissions).alias("submission_id"),
                     F.col("source").alias("submission"),
                     F.concat(F.col("source"), F.lit("/"), folder, F.lit("/f"),
                              F.col("slot").cast("string"), F.lit("."), F.col("ext")).alias("raw_path"),
                     F.when(F.col("ext") == "py", py_content).otherwise(c_content).alias("content"),
                     F.lit(0).alias("entry_ordinal"),
                     F.col("slot")))
    if with_revisions:
        rev = (files.where(F.col("slot") % 7 == 3)
               .withColumn("content", F.concat(F.col("content"), F.lit("revised entry\n")))
               .withColumn("entry_ordinal", F.lit(1)))
        return files.unionByName(rev).drop("slot")
    # one entry per name: no ordinal, so no last-entry-wins shuffle
    return files.drop("slot", "entry_ordinal")


def submission_files(spark: SparkSession, sf_dir: str, with_revisions: bool = False, n_submissions: int = N_SUBMISSIONS) -> DataFrame:
    f = code_files(spark, sf_dir, with_revisions, n_submissions)
    return f.where(~F.col("submission_id").isin(*TEMPLATE_IDS))


def template_files(spark: SparkSession, sf_dir: str, with_revisions: bool = False, n_submissions: int = N_SUBMISSIONS) -> DataFrame:
    """With revisions, the template's repeated names come twice: every entry's hash counts."""
    f = code_files(spark, sf_dir, with_revisions, n_submissions)
    return f.where(F.col("submission_id").isin(*TEMPLATE_IDS)).select("raw_path", "content")


def archive_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): every document as a small zip archive d<doc_id>.zip with a directory, an excluded entry,
    a replaced entry, its text and a file of another type."""

    def pack(batches):
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                blob = io.BytesIO()
                with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as zf:
                    for name, data in (("r/", ""), ("r/build/x.py", "no"), ("r/main.py", "old"), ("r/notes.md", "no"), ("r/A.SQL", "select 1"), ("r/main.py", text or "")):
                        # the same name twice is what the archive shall hold
                        with warnings.catch_warnings():
                            warnings.simplefilter("ignore")
                            zf.writestr(zipfile.ZipInfo(name), data)
                out.append((f"/x/d{i}.zip", blob.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return documents(spark, sf_dir).select("doc_id", "text").mapInPandas(pack, "path string, content binary")


def archive_folder(spark: SparkSession, sf_dir: str, folder: str, docs_each: int = 250) -> None:
    """Write archives g<k>.zip, each of ``docs_each`` documents (doc_id div it) in order of doc_id; for a document a replaced entry, its
    text, a file of another type, an entry in an excluded folder and a stored entry in which the signature of a zip entry stands."""

    def write(key, pdf):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as zf, warnings.catch_warnings():
            warnings.simplefilter("ignore")  # the same name twice is what the archive shall hold
            for i, text in pdf.sort_values("doc_id")[["doc_id", "text"]].itertuples(index=False):
                zf.writestr(f"d{i}/main.py", "old")
                zf.writestr(f"d{i}/notes.md", "no")
                zf.writestr(f"d{i}/build/x.py", "no")
                zf.writestr(f"d{i}/A.SQL", "select 'PK\x03\x04'; " + (text or ""), zipfile.ZIP_STORED)
                zf.writestr(f"d{i}/main.py", text or "")
        name = f"g{key[0]}.zip"
        with store.open_output_stream(f"{root}/_{name}", compression=None) as out:
            out.write(blob.getvalue())
        store.move(f"{root}/_{name}", f"{root}/{name}")
        return pd.DataFrame([(name,)], columns=["name"])

    docs = documents(spark, sf_dir).select("doc_id", "text", F.expr(f"doc_id div {docs_each}").alias("g"))
    docs.groupBy("g").applyInPandas(write, "name string").agg(F.count("name")).collect()  # one number


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, data): every document's text as bytes, by doc_id % 6 in UTF-8 without and with mark, UTF-16 of both orders with mark,
    little-endian UTF-16 without, and Latin-1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = lambda b, name: F.concat(F.lit(b), F.encode(text, name))
    kinds = [F.encode(text, "UTF-8"), mark(b"\xef\xbb\xbf", "UTF-8"), mark(b"\xff\xfe", "UTF-16LE"), mark(b"\xfe\xff", "UTF-16BE"), F.encode(text, "UTF-16LE")]
    data = F.encode(F.regexp_replace(text, "[^\\x{0}-\\x{ff}]", "?"), "ISO-8859-1")
    for i, kind in enumerate(kinds):
        data = F.when(F.col("doc_id") % 6 == i, kind).otherwise(data)
    return documents(spark, sf_dir).select("doc_id", data.alias("data"))
