"""Mixing sources to target weights by systematic sampling.  DataFrame functions only.

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``.  Sources in code-point order, null last, weigh
``weights`` in turn and share the words of all documents: a target is the source's share by weight, at most ``limit`` times
its own words; what is cut off there is shared out again by weight until no target is above.  Taken as a water level:
sources that reach their limit at a lower level come first, and the level of the rest follows from running sums.

Within a source every document is expected target / source size times.  Documents are put in order of size
(then by a digest of the id), their expected copies are added up, one offset per source is
added, drawn from ``seed`` and the source's name, and a document is emitted once for each integer that its stretch of the
running sum crosses: floor(end + offset) - floor(start + offset) times, the rate rounded down or up.  As neighbours
have about the same size, a source's words miss the target by about one document's words at most.

A running sum never runs through one task: rows are sorted over all tasks by range and stored with their partition; a sum is
that of the partitions before plus the one within the partition.  A hot source or a repeated document is thus cut wherever
its rows are.  The table of sources is broadcast while it has at most ``max_broadcast`` rows, else joined by shuffle.

Defined results: null and empty texts have size 0, get copies like any other and take 0 words; a source without words
has target 0 and takes nothing; null is a source, empty string another; rows that repeat a doc_id are documents of their own
(equal ones are interchangeable); an empty table gives an empty result; other columns are ignored (``mixed`` passes them on).
The same rows give the same answer in any order and partitioning.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_key, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SEED = "mix"


def running(rows: DataFrame, order: list, sums: dict[str, F.Column]) -> DataFrame:
    """``rows`` with, for each (name, value) of ``sums``, the sum of the value over all rows before it in ``order``
    (column expressions), written once in that order."""
    part, nth, *past = unused(rows, "part", "nth_row", *(f"past_{n}" for n in sums))
    at = stored(rows.orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(nth, F.monotonically_increasing_id()))
    parts = at.groupBy(part).agg(*(F.sum(v).alias(p) for p, v in zip(past, sums.values())))  # a row per partition
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(part, *(F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(p) for p in past))
    within = Window.partitionBy(part).orderBy(nth).rowsBetween(Window.unboundedPreceding, -1)
    out = at.join(F.broadcast(parts), part)
    return out.select(*(at[c] for c in rows.columns), *((F.col(p) + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(n) for p, (n, v) in zip(past, sums.items())))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3, seed: str = SEED) -> DataFrame:
    """source, n, source_size, first (number of documents of the sources before), target, offset, from (source, n, source_size)."""
    named = running(sizes, [F.asc_nulls_last("source")], {"first": F.col("n"), "nth": F.lit(1)})
    ws = F.array(*(F.lit(w).cast("long") for w in weights))
    named = named.withColumn("w", F.get(ws, F.pmod("nth", F.lit(len(weights))).cast("int"))).withColumn("cap", F.lit(limit) * F.col("source_size"))
    # sorted by the level at which a source is full; kept in whole numbers
    level = F.call_function("div", F.col("cap") * lcm(*weights), F.col("w"))
    filled = stored(running(named, [level, "nth"], {"caps": F.col("cap"), "before": F.col("w")}))
    words, ws = (filled.agg(F.sum(c)).scalar() for c in ("source_size", "w"))
    left, share = words - F.col("caps"), ws - F.col("before")
    # the first source that is not full at the level of those from it on sets the level
    full = left.cast("decimal(38,0)") * F.col("w") > F.col("cap").cast("decimal(38,0)") * share
    filled = stored(filled.select("source", "n", "source_size", "first", "w", "cap", full.alias("full"), (left.cast("double") / share.cast("double")).alias("level")))
    rate = filled.where(~F.col("full")).agg(F.max("level")).scalar()
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.coalesce(rate, F.lit(0.0)) * F.col("w").cast("double"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce("source", F.lit("\x00")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return filled.select("source", "n", "source_size", "first", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"), offset.alias("offset"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3, seed: str = SEED, max_broadcast: int = 100_000) -> DataFrame:
    """doc_id, key (of the text), source, size, source_size, target, copies, taken: one row per row of ``docs``."""
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    # stored first, so that sorting by range, which samples its input, reads the texts once
    rows = stored(docs.select("doc_id", "source", text_key(F.col("text")).alias("key"), size.alias("size"), F.monotonically_increasing_id().alias("row")))
    # the row's number only parts equal rows, so that a range can end between them
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = running(rows, [F.asc_nulls_last("source"), "size", digest, "doc_id", "key", "row"], {"rank": F.lit(1)})
    rows = stored(rows.drop("row"))
    plan = stored(targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, limit, seed))
    plan = plan.withColumnRenamed("source", "of")
    plan = F.broadcast(plan) if plan.count() <= max_broadcast else plan
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.floor((F.col("rank") - F.col("first")).cast("double") * rate + F.col("offset"))
    end = F.floor((F.col("rank") - F.col("first") + 1).cast("double") * rate + F.col("offset"))
    found = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", F.least(end - start, F.lit(limit).cast("long")))
    return found.select("doc_id", "key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = 3, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as it is taken.  Of rows with equal doc_id, source and text, which
    together are taken k times, each gets k / m of it, rounded down or up."""
    i, k, s, times, m, row, nth, base = unused(docs, "id", "key", "of", "times", "m", "row", "nth", "base")
    per = copies(docs, weights, limit, seed).groupBy("doc_id", "key", "source").agg(F.sum("copies").alias(times), F.count("*").alias(m))
    per = stored(per.select(F.col("doc_id").alias(i), F.col("key").alias(k), F.col("source").alias(s), times, m))

    def placed(rows: DataFrame, some: DataFrame) -> DataFrame:
        return rows.join(some, rows["doc_id"].eqNullSafe(some[i]) & (text_key(rows["text"]) == some[k]) & rows["source"].eqNullSafe(some[s]))

    single = placed(docs, per.where(F.col(m) == 1)).withColumn(nth, F.lit(0).cast("long"))
    firsts = running(per.where(F.col(m) > 1), [i, k, s], {base: F.col(m)})
    again = placed(docs, firsts).withColumn(row, F.monotonically_increasing_id())
    again = running(again, [i, k, s, row], {nth: F.lit(1).cast("long")}).withColumn(nth, F.col(nth) - F.col(base))
    rows = single.select(*docs.columns, times, m, nth).unionByName(again.select(*docs.columns, times, m, nth))
    n = F.floor(F.col(times) / F.col(m)) + F.when(F.col(nth) < F.pmod(times, m), 1).otherwise(0)
    return rows.withColumn(times, n).where(F.col(times) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)
