"""Self-joins whose groups may be of any size.

A key held by m rows gives m^2 pairs, however few bytes the rows have, so a byte-based skew split does not
help.  Here a key of more than ``limit`` rows is cut into ceil(m / limit) blocks by a hash of the row's identity, and
every pair of blocks is a join group of its own: no group joins more than about limit x limit rows, the groups of a
hot key spread over all tasks, and every pair is found exactly once.  ``limit`` changes how the work is
divided, never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2000


def less(cols: list[str], x: str, y: str) -> F.Column:
    """Lexicographic order of ``cols`` with the suffixes x and y."""
    out = F.lit(False)
    for c in reversed(cols):
        a, b = F.col(f"{c}{x}"), F.col(f"{c}{y}")
        out = (a < b) | ((a == b) & out)
    return out


def blocked(rows: DataFrame, keys: list[str], ident: list[str], limit: int = LIMIT, size: str | None = None, rank=None) -> DataFrame:
    """``rows`` with _k, the number of blocks of the row's key, and _t, the row's block.  ``size`` names a column that
    already has the number of rows of the key, which saves counting them."""
    if size:
        out = rows.withColumn("_k", F.greatest(F.ceil(F.col(size) / limit), F.lit(1)).cast("int"))
    else:
        hot = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > limit)
               .select(*keys, F.ceil(F.col("_m") / limit).cast("int").alias("_k")))
        out = rows.join(hot, keys, "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    block = F.pmod(F.xxhash64(*ident), F.col("_k")) if rank is None else F.least(F.floor(rank * F.col("_k")), F.col("_k") - 1)
    return out.withColumn("_t", block.cast("int"))


def self_pairs(rows: DataFrame, keys: list[str], ident: list[str], values: list[str] = (),
               limit: int = LIMIT, size: str | None = None, rank=None) -> DataFrame:
    """All pairs of rows with equal ``keys`` and different ``ident``, once each: the keys, then ident and values
    of the smaller row (suffix _1) and of the larger (suffix _2), in the order of ``ident``.

    ``rank``, if given, is a column from 0 to 1 that is evenly spread and never falls as ``ident`` grows.  Blocks are
    then ranges of it, so a lower block holds the smaller rows and no pair has to be turned round."""
    cols = [*ident, *values]
    other = F.col("_o").cast("int")
    keep = dict.fromkeys([*keys, *cols, *([size] if size else [])])
    tiles = (blocked(rows.select(*keep), keys, ident, limit, size, rank)
             .withColumn("_o", F.explode_outer(F.sequence(F.lit(0), F.col("_k") - 1)))
             .withColumn("_i", F.least(other, "_t")).withColumn("_j", F.greatest(other, "_t")))
    x, y = ("_1", "_2") if rank is not None else ("_x", "_y")
    left = tiles.where(F.col("_t") == F.col("_i")).select(*keys, "_i", "_j", *[F.col(c).alias(f"{c}{x}") for c in cols])
    right = tiles.where(F.col("_t") == F.col("_j")).select(*keys, "_i", "_j", *[F.col(c).alias(f"{c}{y}") for c in cols])
    pairs, x_first = left.join(right, [*keys, "_i", "_j"]), less(ident, x, y)
    if rank is not None:
        return pairs.where(x_first).drop("_i", "_j")
    pairs = pairs.where((F.col("_i") < F.col("_j")) | x_first)

    def pick(c: str, first: str, second: str, name: str) -> F.Column:
        return F.when(x_first, F.col(f"{c}{first}")).otherwise(F.col(f"{c}{second}")).alias(name)

    return pairs.select(*keys, *[pick(c, "_x", "_y", f"{c}_1") for c in cols], *[pick(c, "_y", "_x", f"{c}_2") for c in cols])
