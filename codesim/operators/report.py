"""Report operators: overall score per submission pair, suspicious pairs,
flagged files, watch-term counts, line overlap of flagged files, run summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..params import Params
from .blocks import LIMIT, self_pairs
from .terms import MANY
from .terms import term_counts as automaton_counts


def neumaier_sum(arr) -> F.Column:
    """Compensated sum of a (short) array, in array order: the summation
    Python's built-in ``sum`` uses for floats, so means of equal inputs come
    out bit-identical."""
    init = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc, x):
        s, c = acc["s"], acc["c"]
        t = s + x
        comp = F.when(F.abs(s) >= F.abs(x), (s - t) + x).otherwise((x - t) + s)
        return F.struct(t.alias("s"), (c + comp).alias("c"))

    return F.aggregate(arr, init, step, lambda acc: acc["s"] + acc["c"])


def top_similarities(sims: DataFrame, n: int) -> DataFrame:
    """(id_a, id_b, top array<double> descending, <= n values).  The
    ``row_number() <= n`` filter lets Spark keep a per-task top-n before the
    shuffle, so one huge submission pair never funnels all its file pairs
    into a single task."""
    w = Window.partitionBy("id_a", "id_b").orderBy(F.desc("similarity"))
    top = (sims.select("id_a", "id_b", "similarity")
           .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n))
    return (top.groupBy("id_a", "id_b")
            .agg(F.sort_array(F.collect_list("similarity"), asc=False).alias("top")))


def pair_counts(pos: DataFrame) -> DataFrame:
    """(id_a, id_b, n_pos, n_cross) per submission pair of the positive table."""
    return pos.groupBy("id_a", "id_b").agg(
        F.count(F.lit(1)).alias("n_pos"),
        F.sum(F.when(F.col("kind") == "cross", 1).otherwise(0)).alias("n_cross"))


def overall_from_positive(pos: DataFrame, common: DataFrame, top_n: int,
                          counts: DataFrame | None = None) -> DataFrame:
    """Exact overall = mean of the top ``top_n`` of all file similarities of a
    pair, from the positive ones only: zeros (same-path pairs sharing
    nothing) never enter a top-n sum, they only raise the divisor
    min(top_n, n_cross + n_common).  ``common`` may cover only the pairs with
    fewer than ``top_n`` positives: for the others the divisor is top_n.
    Pairs without a positive similarity are not returned (overall 0.0)."""
    top = top_similarities(pos, top_n)
    counts = pair_counts(pos) if counts is None else counts
    j = top.join(counts, ["id_a", "id_b"]).join(common, ["id_a", "id_b"], "left")
    n_all = F.col("n_cross") + F.coalesce(F.col("n_common"), F.lit(0))
    denom = F.least(F.lit(top_n), F.greatest(F.col("n_pos"), n_all))
    return j.select("id_a", "id_b", (neumaier_sum(F.col("top")) / denom).alias("overall"))


def all_submission_pairs(subs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every (id_a, id_b), id_a < id_b, for any unique ids: an equi-join of blocks of at most about
    ``limit`` submissions, no cross join."""
    rows = subs.select(F.lit(0).alias("_all"), "submission_id")
    return self_pairs(rows, ["_all"], ["submission_id"], [], limit).select(
        F.col("submission_id_1").alias("id_a"), F.col("submission_id_2").alias("id_b"))


def name_pairs(pairs: DataFrame, subs: DataFrame) -> DataFrame:
    sa = subs.select(F.col("submission_id").alias("id_a"), F.col("submission").alias("submission_a"),
                     F.col("student_lines").alias("student_lines_a"))
    sb = subs.select(F.col("submission_id").alias("id_b"), F.col("submission").alias("submission_b"),
                     F.col("student_lines").alias("student_lines_b"))
    return pairs.join(sa, "id_a").join(sb, "id_b")


def suspicious(overall: DataFrame, subs: DataFrame, params: Params) -> DataFrame:
    """Pairs with overall >= threshold, named, banded, best first."""
    kept = overall.where(F.col("overall") >= params.overall_thresh)
    named = name_pairs(kept, subs)
    return (named.select("id_a", "id_b", "submission_a", "submission_b", "overall",
                         T.severity("overall").alias("severity"), "student_lines_a", "student_lines_b")
            .orderBy(F.desc("overall"), "id_a", "id_b"))


def flagged(sims: DataFrame, kept_pairs: DataFrame, params: Params) -> DataFrame:
    """Same-path pairs >= file threshold and cross-path pairs >= cross
    threshold of the reported submission pairs; first ``max_flagged`` per
    pair by similarity, ties by (path_a, path_b)."""
    hit = (((F.col("kind") == "same") & (F.col("similarity") >= params.file_thresh))
           | ((F.col("kind") == "cross") & (F.col("similarity") >= params.cross_thresh)))
    f = sims.where(hit).join(kept_pairs.select("id_a", "id_b"), ["id_a", "id_b"], "left_semi")
    w = Window.partitionBy("id_a", "id_b").orderBy(F.desc("similarity"), "path_a", "path_b")
    return (f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= params.max_flagged)
            .select("id_a", "id_b", F.col("rank").cast("int"), "path_a", "path_b", "kind", "similarity",
                    T.severity("similarity").alias("severity")))


def with_term_counts(files: DataFrame, params: Params, on=None) -> DataFrame:
    """Add ``term_n``: per-file counts of each watch term (in parameter
    order) over the raw content, whole words, any case; null where ``on``
    is false.  One literal pattern per term, compiled once per task; many terms
    are counted by one automaton instead (``terms``), with the same counts."""
    on = F.lit(True) if on is None else on
    terms = list(params.terms)
    if len(terms) >= MANY:
        return files.withColumn("term_n", automaton_counts(F.when(on, F.col("content")), params.terms))
    low = F.lower(F.col("content"))
    counts = F.array(*[T.term_count(low, t) for t in terms]) if terms else F.array().cast("array<long>")
    return files.withColumn("term_n", F.when(on, counts))


def term_counts(kept: DataFrame, subs: DataFrame, params: Params) -> DataFrame:
    """(submission_id, term, n) for every submission and term, zeros included,
    summed per submission with a partial aggregate.  ``kept`` carries
    ``term_n`` (see ``with_term_counts``) or the raw ``content``."""
    terms = list(params.terms)
    if not terms:
        return subs.sparkSession.createDataFrame([], "submission_id long, term string, n long")
    if "term_n" not in kept.columns:
        kept = with_term_counts(kept, params)
    names = F.array(*[F.lit(t) for t in terms])
    per_file = kept.select("submission_id", T.explode_rows(F.arrays_zip(names.alias("term"),
                                                                       F.col("term_n").alias("n"))).alias("tc"))
    counts = (per_file.where(F.col("tc").isNotNull())
              .groupBy("submission_id", F.col("tc.term").alias("term")).agg(F.sum("tc.n").alias("n")))
    grid = subs.select("submission_id", F.explode(names).alias("term"))
    return (grid.join(counts, ["submission_id", "term"], "left")
            .select("submission_id", "term", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def line_overlap(flags: DataFrame, files: DataFrame) -> DataFrame:
    """Bag overlap of the lines of each flagged file pair: common, only_a,
    only_b (order-free; stands in for a side-by-side diff).  ``files`` are the flagged
    files (submission_id, path, content); their lines are split and counted once per file."""
    key = ["id_a", "id_b", "path_a", "path_b"]
    lines = (files.select("submission_id", "path", T.explode_rows(T.split_lines("content")).alias("line"))
             .where(F.col("line").isNotNull()).groupBy("submission_id", "path", "line").agg(F.count(F.lit(1)).alias("c")))

    def side(s: str) -> DataFrame:
        own = lines.select(F.col("submission_id").alias(f"id_{s}"), F.col("path").alias(f"path_{s}"), "line", "c")
        zero = F.lit(0).cast("long")
        return flags.select(*key).join(own, [f"id_{s}", f"path_{s}"]).select(
            *key, "line", (F.col("c") if s == "a" else zero).alias("ca"), (F.col("c") if s == "b" else zero).alias("cb"))

    per_line = side("a").unionByName(side("b")).groupBy(*key, "line").agg(F.sum("ca").alias("a"), F.sum("cb").alias("b"))
    out = per_line.groupBy(*key).agg(
        F.sum(F.least("a", "b")).cast("long").alias("common"),
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).cast("long").alias("only_a"),
        F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).cast("long").alias("only_b"))
    # flagged pairs whose both files have no lines still get a row
    return (flags.select(*key).join(out, key, "left")
            .select(*key, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                            for c in ("common", "only_a", "only_b")]))


def term_counts_wide(counts: DataFrame, terms) -> DataFrame:
    """One row per submission, one column per term (the term table's wide view)."""
    terms = list(terms)
    return (counts.groupBy("submission_id").pivot("term", terms).agg(F.first("n"))
            .select("submission_id", *[F.coalesce(F.col(t), F.lit(0)).cast("long").alias(t) for t in terms]))
