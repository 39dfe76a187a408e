"""Template subtraction and per-file facts.

A file is *template* when the SHA-256 of its normalised content equals that of
any admitted template file (path-independent); it is *kept* when it is not
template and has at least ``min_lines`` newlines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..params import Params
from . import corpus


def template_hashes(template: DataFrame | None, params: Params, spark=None) -> DataFrame:
    """Distinct normalised-content hashes of all admitted template entries, repeated names
    included.  The extension of the original name picks the normaliser; no prefix strip,
    no size filter.  ``None`` gives an empty table (subtracts nothing)."""
    if template is None:
        return spark.createDataFrame([], "norm_hash string")
    t = corpus.admit(template, params)
    ext = T.extension("raw_path")
    return t.select(T.norm_hash(T.normalize(F.col("content"), ext)).alias("norm_hash")).distinct()


def normalized(files: DataFrame) -> DataFrame:
    """Files (with ``ext`` and ``content``) plus norm, norm_hash and n_newlines, all in the stage that reads them."""
    return (files.withColumn("norm", T.normalize(F.col("content"), F.col("ext")))
            .withColumn("norm_hash", T.norm_hash(F.col("norm")))
            .withColumn("n_newlines", T.newline_count("content")))


def marked(files: DataFrame, hashes: DataFrame, params: Params) -> DataFrame:
    """Narrow file rows (norm_hash, n_newlines, ..) plus is_template and is_kept: a left join against the
    distinct hash table.  Contents must be gone by now: what it is given may be shuffled by hash."""
    is_template = F.coalesce(F.col("_tpl"), F.lit(False))
    f = files.join(hashes.select("norm_hash", F.lit(True).alias("_tpl")), "norm_hash", "left")
    return (f.withColumn("is_template", is_template)
            .withColumn("is_kept", ~is_template & (F.col("n_newlines") >= params.min_lines))
            .drop("_tpl"))


def submissions(files_or_roster: DataFrame, facts: DataFrame) -> DataFrame:
    """total_lines (all prepared files), student_lines (kept files),
    template_pct; one row per submission of the roster even with no files."""
    roster = files_or_roster.select("submission_id", "submission").distinct()
    lines = (facts.groupBy("submission_id")
             .agg(F.sum("n_newlines").alias("total_lines"),
                  F.sum(F.when(F.col("is_kept"), F.col("n_newlines")).otherwise(0)).alias("student_lines")))
    out = roster.join(lines, "submission_id", "left")
    total = F.coalesce(F.col("total_lines"), F.lit(0)).cast("long")
    student = F.coalesce(F.col("student_lines"), F.lit(0)).cast("long")
    pct = F.when(total == 0, F.lit(0.0)).otherwise(100.0 * (total - student) / total)
    return out.select("submission_id", "submission", total.alias("total_lines"),
                      student.alias("student_lines"), pct.alias("template_pct"))
