"""Intake of submissions as a stream: each micro-batch is compared with the stored index and then added to it.

A batch holds whole submissions.  Its counts are written as a table of its own, named by the batch, before the index takes the batch in; the
index's manifest tells which batches are done.  A batch that is run again after a failure overwrites its table and is added once, so
a replay leaves the same counts as a run without failures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..operators import index as stored
from ..operators.index import COUNTS, Index
from ..operators.similarity import shared_shingle_counts
from ..params import Params
from ..plans.analyze import Analysis


def take_in(batch: DataFrame, number: int, folder: str, template: DataFrame | None, params: Params, buckets: int = 64) -> None:
    """Compare the files of ``batch`` (submission_id, submission, raw_path, content) with the index under ``folder`` and add them; the
    first batch builds the index."""
    spark, label = batch.sparkSession, f"batch-{number}"
    path = f"{folder}/index"
    index: Index | None = None
    if stored._exists(spark, f"{path}/manifest"):
        index = stored.open_index(spark, path)
        if index.has(label):
            return
    elif stored._exists(spark, path):  # the first batch failed while it built the index
        from ..session import delete

        delete(spark, path)
    if batch.isEmpty():
        return
    a = Analysis(batch, template, params)
    counts = index.counts_added(a.sets, a.reps, a._keep) if index else shared_shingle_counts(a.reps, a.sets, params.block_rows)
    counts.select(*COUNTS).write.mode("overwrite").parquet(f"{folder}/counts/{label}")
    if index:
        index.add(a.sets, a.reps, label)
    else:
        stored.build(spark, path, a.sets, a.reps, buckets, params.block_rows, label)
    a.cleanup()


def intake(files: DataFrame, folder: str, template: DataFrame | None = None, params: Params = Params(), buckets: int = 64) -> DataStreamWriter:
    """A writer for the stream ``files``; start it with the trigger of choice.  Its checkpoint lies under ``folder`` too."""
    return (files.writeStream.foreachBatch(lambda batch, number: take_in(batch, number, folder, template, params, buckets))
            .option("checkpointLocation", f"{folder}/checkpoint"))


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """The shared-shingle counts of all submissions taken in so far."""
    done = [r["label"] for r in stored.open_index(spark, f"{folder}/index").additions().collect()]  # a row per batch
    return spark.read.parquet(*[f"{folder}/counts/{label}" for label in done])
