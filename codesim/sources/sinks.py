"""Result sink: write the result tables of an analysis.

Each run writes a version of its own (parquet by default, or any
``DataFrameWriter`` format such as json) and names it in a manifest last, with the flagged files nested
under their pair for a report-shaped view in ``pair_report``.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete


def pair_report(pairs: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row per reported pair with its flagged files as an ordered array."""
    nested = (flagged.groupBy("id_a", "id_b")
              .agg(F.sort_array(F.collect_list(F.struct("rank", "path_a", "path_b", "kind", "similarity",
                                                        "severity"))).alias("flagged_files")))
    return pairs.join(nested, ["id_a", "id_b"], "left").withColumn(
        "flagged_files", F.coalesce("flagged_files", F.array().cast(nested.schema["flagged_files"].dataType)))


def write_tables(analysis, out: str, fmt: str = "parquet", keep: int | None = None) -> dict[str, str]:
    """Write submissions, term counts, pairs, flagged files, line overlap,
    summary and the nested pair report as a new version; returns name -> path.  Build the
    analysis with ``persist=True`` so the tables share one computation of
    the file facts, shingle sets and file pairs.

    The tables go to a folder of their own, ``<out>/versions/<version>``; what makes them the current version is one file
    in ``<out>/manifest`` that is written after the last of them.  A run that fails on the way leaves the version before readable, and readers
    of that one are never disturbed.  ``keep``, if given, is how many versions stay; older ones are deleted at the end."""
    spark = analysis.spark
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"  # later versions sort after
    tables = dict(analysis.tables())
    tables["pair_report"] = pair_report(analysis.pairs, analysis.flagged_files)
    paths = {}
    for name, df in tables.items():
        path = os.path.join(out, "versions", version, name)
        df.write.mode("errorifexists").format(fmt).save(path)
        paths[name] = path
    rows = spark.createDataFrame([(version, name, fmt, f"versions/{version}/{name}") for name in paths], MANIFEST)
    rows.coalesce(1).write.mode("append").json(os.path.join(out, "manifest"))
    if keep is not None:
        for old in versions(spark, out)[keep:]:
            delete(spark, os.path.join(out, "versions", old))
    return paths


MANIFEST = "version string, name string, format string, path string"


def versions(spark: SparkSession, out: str) -> list[str]:
    """The whole versions under ``out``, the current one first."""
    found = spark.read.schema(MANIFEST).json(os.path.join(out, "manifest")).select("version").distinct()
    return sorted((r["version"] for r in found.collect()), reverse=True)  # one row a run


def read_tables(spark: SparkSession, out: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of the current version, or of a given one that is still kept."""
    version = version or versions(spark, out)[0]
    rows = spark.read.schema(MANIFEST).json(os.path.join(out, "manifest")).where(F.col("version") == version).collect()
    if not rows:
        raise ValueError(f"no version {version} under {out}")
    return {r["name"]: spark.read.format(r["format"]).load(os.path.join(out, r["path"])) for r in rows}
