"""A stored shingle index: new submissions are compared with everything seen before without reading it anew.

Three bucketed tables under one folder hold what the shingle join needs of the old side: ``shingles`` (h, t, class), bucketed by
(h, t); ``members`` (class, t, submission_id, path, ext, n_shingles), bucketed by (class, t); ``classes``, bucketed by class.  A query shuffles the
new submissions' rows to those buckets; the old side is joined where it lies, without an exchange.  What it keeps there, the
keys that new files have and the files of their classes, meets the new classes in tiles (``tiles``), so that no pair is shuffled.

t splits hot keys: a shingle of m classes (a class of m members) when the index is built has ceil(m / ``limit``)
blocks, rows go to one by hash, and the query's row goes to each.  The counts of blocks over one stand in two small
tables.  Keys that become hot by later additions are split when the index is built anew.

An addition writes its rows under a name of its own and then one line in the manifest; rows whose name is not there are never read,
so an addition that fails on the way, or is run again, changes nothing.  The index is opened from its folder alone; the session's catalogue
only holds the tables' names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from . import tiles
from .blocks import LIMIT
from .similarity import CLS, class_rank, class_seats, class_shingles, shared_keys, shared_sets, shared_shingle_counts

COUNTS = ["id_a", "path_a", "id_b", "path_b", "inter", "ext", "n_a", "n_b"]
#: Keys of the new submissions that one task groups.
KEYS_EACH = 8_000_000
#: table: bucketed by
TABLES = {"shingles": ["h", "t"], "members": [*CLS, "t"], "classes": CLS}


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    buckets: int
    limit: int

    # -- folder -------------------------------------------------------------
    def _name(self, table: str) -> str:
        """The table's name in this session's catalogue."""
        return f"codesim_{table}_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"

    def _table(self, table: str) -> DataFrame:
        """The table's rows of the additions in the manifest."""
        name = self._name(table)
        if not self.spark.catalog.tableExists(name):
            keys = ", ".join(TABLES[table])
            columns = self.spark.read.parquet(f"{self.path}/{table}").schema
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
            self.spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'")
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name).where(F.col("addition").isin([r["addition"] for r in self.additions().collect()])).drop("addition")

    def additions(self) -> DataFrame:
        """(addition, label): a row for each whole addition."""
        return self.spark.read.schema("addition string, label string").json(f"{self.path}/manifest")

    def has(self, label: str) -> bool:
        return not self.additions().where(F.col("label") == label).isEmpty()

    def _hot(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/hot_{table}")

    def _placed(self, rows: DataFrame, table: str, ident: list[str]) -> DataFrame:
        keys = TABLES[table][:-1]
        k = F.coalesce("k", F.lit(1).cast("long"))
        return rows.join(self._hot(table), keys, "left").withColumn("t", F.pmod(F.xxhash64(*ident), k).cast("int")).drop("k")

    def _everywhere(self, rows: DataFrame, table: str) -> DataFrame:
        """``rows`` once for each block of their key."""
        keys = TABLES[table][:-1]
        k = F.coalesce("k", F.lit(1).cast("long"))
        return rows.join(self._hot(table), keys, "left").withColumn("t", F.explode(F.sequence(F.lit(0), (k - 1).cast("int")))).drop("k")

    # -- writing ------------------------------------------------------------
    def add(self, sets: DataFrame, reps: DataFrame, label: str = "") -> None:
        """Add the submissions of ``sets`` with the classes of ``reps`` (an analysis' ``sets`` and ``reps``)."""
        addition = uuid.uuid4().hex
        fresh = reps if self._empty() else reps.join(self._table("classes"), CLS, "left_anti")
        tables = {
            "shingles": self._placed(class_shingles(fresh).select("h", *CLS), "shingles", CLS),
            "members": self._placed(sets.select(*CLS, "submission_id", "path", "ext", "n_shingles"), "members", ["submission_id", "path"]),
            "classes": fresh.select(*CLS),
        }
        for table, rows in tables.items():
            keys = TABLES[table]
            (rows.repartition(self.buckets, *keys).withColumn("addition", F.lit(addition)).write.mode("append").format("parquet")
             .bucketBy(self.buckets, *keys).sortBy(*keys).option("path", f"{self.path}/{table}").saveAsTable(self._name(table)))
        self.spark.createDataFrame([(addition, label)], "addition string, label string").coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _empty(self) -> bool:
        return not self.spark.catalog.tableExists(self._name("classes")) and not _exists(self.spark, f"{self.path}/manifest")

    # -- reading ------------------------------------------------------------
    def counts_with_old(self, sets: DataFrame, reps: DataFrame, keep: Callable[..., DataFrame] | None = None) -> DataFrame:
        """Shared-shingle counts (``similarity.shared_shingle_counts``) of every pair of a new and an old file of different submissions.
        Old classes keep the keys that a new file has and meet the new ones in tiles, so no pair is shuffled; ``keep`` writes the new ones' blocks."""
        new = self._everywhere(class_shingles(reps).select("h").distinct(), "shingles")
        shingles = self._table("shingles")
        held = shingles.join(new, ["h", "t"], "left_semi").groupBy(*CLS).agg(F.collect_list("h").alias("keys"))
        files = F.collect_list(F.struct("submission_id", "path"))
        old = self._table("members").groupBy(*CLS, "t").agg(files.alias("files"), F.first("ext").alias("ext"), F.max("n_shingles").cast("long").alias("n"))
        least = tiles.number_of_blocks(reps.limit(0))
        # all keys of the old side are the most that it can keep
        blocks = max(least, -(-shingles.count() // tiles.KEYS_EACH))
        rows = old.join(self._everywhere(held, "members"), [*CLS, "t"])
        rows = rows.select(*CLS, "n", "ext", "files", "keys", F.least(F.floor(class_rank() * blocks), F.lit(blocks - 1)).cast("int").alias("b"))
        mine = tiles.stored_blocks(reps.where(F.size("keys") > 0), class_seats(sets, reps), self.limit, 0.0, tiles.number_of_blocks(reps), keep)
        return tiles.pairs_between(mine, tiles.packed(rows, blocks), sets).select(*COUNTS)

    def counts_added(self, sets: DataFrame, reps: DataFrame, keep: Callable[..., DataFrame] | None = None) -> DataFrame:
        """What the new submissions add to the counts of the old ones: pairs with them, and pairs among themselves."""
        store = keep or (lambda df, *a: materialise(df, *a)[0])
        if dict(reps.dtypes)["keys"] == "array<bigint>":
            parts = -(-(reps.agg(F.sum("n")).first()[0] or 0) // KEYS_EACH) + self.spark.sparkContext.defaultParallelism
            shared = shared_keys(reps.drop("keys"), reps.select(*CLS, "keys"), parts)
        else:
            shared = shared_sets(reps)
        shared = store(shared, "shared_sets")
        among = shared_shingle_counts(reps, sets, self.limit, shared, blocks=tiles.number_of_blocks(shared), keep=keep)
        return self.counts_with_old(sets, reps, keep).unionByName(among.select(*COUNTS))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def build(spark: SparkSession, path: str, sets: DataFrame, reps: DataFrame, buckets: int = 64, limit: int = LIMIT, label: str = "") -> Index:
    """A new index under ``path``, which must not exist, of an analysis' ``sets`` and ``reps``; ``buckets`` is best about
    the bytes of all shingles / 128 MB."""
    if _exists(spark, path):
        raise ValueError(f"{path} exists")
    spark.createDataFrame([(buckets, limit)], "buckets int, limit int").coalesce(1).write.json(f"{path}/settings")
    index = Index(spark, path, buckets, limit)
    hot = class_shingles(reps).groupBy("h").agg(F.count(F.lit(1)).alias("m"))
    hot.where(F.col("m") > limit).select("h", F.ceil(F.col("m") / limit).cast("long").alias("k")).write.parquet(f"{path}/hot_shingles")
    hot = sets.groupBy(*CLS).agg(F.count(F.lit(1)).alias("m"))
    hot.where(F.col("m") > limit).select(*CLS, F.ceil(F.col("m") / limit).cast("long").alias("k")).write.parquet(f"{path}/hot_members")
    index.add(sets, reps, label)
    return index


def open_index(spark: SparkSession, path: str) -> Index:
    r = spark.read.schema("buckets int, limit int").json(f"{path}/settings").first()
    return Index(spark, path, r["buckets"], r["limit"])
