"""Corpus operators: admit entries, last entry wins, strip the common first
directory.  Input rows: (submission_id, submission, raw_path, content
[, entry_ordinal]).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..params import Params


def admit(files: DataFrame, params: Params) -> DataFrame:
    """Allowed extension (of the raw name) and no excluded path component."""
    ext = T.extension("raw_path")
    return files.where(ext.isin(*params.allowed_exts) & ~T.excluded("raw_path", params.exclude_dirs))


def last_entry_wins(files: DataFrame) -> DataFrame:
    """A name repeated inside one archive keeps its last entry.  ``max_by`` is
    partially aggregated before the shuffle, so even a heavily repeated name
    sends one row per map task."""
    if "entry_ordinal" not in files.columns:
        return files
    keys = [c for c in ("submission_id", "submission", "raw_path") if c in files.columns]
    return (files.groupBy(*keys)
            .agg(F.max_by("content", "entry_ordinal").alias("content")))


def admitted(files: DataFrame, params: Params) -> DataFrame:
    """The files that count, contents included.  ``params.scan_partitions`` deals them out anew,
    for inputs whose reader cannot split them; 0 leaves them as read."""
    f = last_entry_wins(admit(files, params))
    return f.repartition(params.scan_partitions) if params.scan_partitions else f


def strip_common_prefix(files: DataFrame, compat: bool = False) -> DataFrame:
    """Drop the first path component of every file of a submission when all of
    its admitted files share it (one level only).  Adds ``path``.

    The per-submission test is an aggregate (partial, a few bytes per
    submission) joined back, not a window: a submission holding a third of
    all files must not land in one task.  Give it narrow rows: what it is
    given may be shuffled by submission."""
    c0 = T.first_component("raw_path")
    per_sub = (files.groupBy("submission_id")
               .agg(F.min(c0).alias("_c0_min"), F.max(c0).alias("_c0_max"))
               .select("submission_id", (F.col("_c0_min") == F.col("_c0_max")).alias("_strip")))
    return (files.join(per_sub, "submission_id")
            .withColumn("path", F.when(F.col("_strip"), T.drop_first_component("raw_path", compat))
                        .otherwise(F.col("raw_path")))
            .drop("_strip"))
