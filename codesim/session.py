"""Session helpers: a local session for tests and the bench, and the shared
folder for materialised intermediate tables.

On a cluster the session is created by the platform and left alone; the settings below are
those of ``local_session`` and what is recommended there.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime broadcast only below this size (bytes, measured by AQE on the real
# shuffle output); anything larger stays a sort-merge join.
BROADCAST_LIMIT = 32 * 1024 * 1024

SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(BROADCAST_LIMIT),
    # static planning must not broadcast tables whose size it only guesses
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  scratch: str | None = None) -> SparkSession:
    """Local session for tests and the bench; UI off, event log optional."""
    b = (SparkSession.builder.master(f"local[{cpus}]")
         .appName("codesim")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g")
         # recording the Python call site of every Column costs several round trips to the JVM each
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in SQL_CONF.items():
        b = b.config(k, v)
    if scratch:
        b = (b.config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", scratch))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables, from the session's
    ``spark.checkpoint.dir``.  Only a local master, as in tests, may run without it; a
    scratch folder is then created and registered."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="codesim-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialise(df, name: str, rows_each: int = 0):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back, (table, path): cuts lineage (a lost executor re-reads the table instead of
    recomputing the plan) and freezes the result for its many consumers.  ``rows_each``: the most
    rows of a file (0: any number)."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_each).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table, wherever its folder lives."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
