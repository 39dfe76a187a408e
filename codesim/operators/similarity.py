"""File-pair similarity between submissions (Jaccard of shingle sets).

Orientation is always ``id_a < id_b`` (input order).  Two kinds of pairs feed
the overall score:

- *same-path*: every common path of two submissions, zeros included;
- *cross-path*: different paths of the same extension sharing >= 1 shingle.

Files with identical normalised content (same extension) form one *content
class*.  Classes meet in one self-join of their shingles; class pairs are then
expanded to the file pairs of their members.  Every self-join goes through
``blocks.self_pairs``, which cuts hot keys (a shingle in every class, a class
with very many copies, a very common path) into blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import tiles
from .blocks import LIMIT, blocked, self_pairs

EPS = 1e-9
PAIR = ["id_a", "path_a", "id_b", "path_b"]
CLS = ["cls_hi", "cls_lo"]
CLS_PAIR = ["cls_hi_1", "cls_lo_1", "cls_hi_2", "cls_lo_2"]


def content_classes(sets: DataFrame) -> DataFrame:
    """One row per content class of ``sets``: (cls_hi, cls_lo, n, members); narrow."""
    classes = sets.groupBy(*CLS).agg(F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("members"))
    return classes.where(F.col("n").isNotNull())


def with_keys(classes: DataFrame, keyed: DataFrame) -> DataFrame:
    """``classes`` plus their keys.  ``keyed`` has the key array of every scanned file; ``first`` is partially
    aggregated, so one array per class and map task crosses the shuffle,
    however many copies the class has."""
    arrays = keyed.groupBy(*CLS).agg(F.first("keys", ignorenulls=True).alias("keys"))
    return classes.join(arrays, CLS)


def class_reps(sets: DataFrame, keyed: DataFrame) -> DataFrame:
    """One row per content class of ``sets``: (cls_hi, cls_lo, n, members, keys)."""
    return with_keys(content_classes(sets), keyed)


def class_rank() -> F.Column:
    """Place of a class in the order of CLS, from 0 to 1: the high part is 60 evenly spread bits."""
    return F.col("cls_hi") / F.lit(float(2**60))


def class_seats(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """The files of ``sets`` with the number of members of their class."""
    return sets.join(reps.select(*CLS, "members"), CLS)


def class_shingles(reps: DataFrame) -> DataFrame:
    return (reps.select(*CLS, "n", "members", T.explode_rows("keys").alias("h"))
            .where(F.col("h").isNotNull()))


def shared_sets(reps: DataFrame, parts: int = 0) -> DataFrame:
    """The classes of ``reps`` with those of their keys that stand in other classes too, the frequent before the rare (document
    frequency over classes, then key): (cls_hi, cls_lo, n, members, keys); ``n`` still counts all shingles.  A shingle of one
    class can't pair it, so every join of classes reads this table; most shingles of a corpus are of one class.  ``parts`` is the
    number of partitions the shingles are dealt to (0: the session's)."""
    sh = class_shingles(reps)
    sh = sh.repartition(parts, "h") if parts else sh
    sh = sh.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h"))).where(F.col("df") > 1)
    keys = F.transform(F.sort_array(F.collect_list(F.struct("df", "h")), asc=False), lambda x: x["h"])
    return sh.groupBy(*CLS).agg(F.first("n").alias("n"), F.first("members").alias("members"), keys.alias("keys"))


def _lists(flat: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(flat))


def _flat(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a column of lists and the row of each."""
    size = np.nan_to_num(keys.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return keys.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(keys), dtype=np.int32), size)


def dealt_keys(keyed: DataFrame, parts: int) -> DataFrame:
    """(p, cls_hi, cls_lo, keys): the numeric keys of each row of ``keyed``, one row for each remainder p by ``parts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                flat, row = _flat(part.column(2))
                group = row * np.int64(parts) + flat % parts
                order = np.argsort(group, kind="stable")
                own, count = np.unique(group, return_counts=True)
                rows = pa.array(own // parts)
                yield pa.RecordBatch.from_arrays([pa.array((own % parts).astype(np.int32)), part.column(0).take(rows), part.column(1).take(rows), _lists(flat[order], count)],
                                                 ["p", *CLS, "keys"])

    # rows without keys give none; a filter on keys that are computed here would compute them, and the tokens for each, again
    return keyed.select(*CLS, "keys").mapInArrow(run, "p int, cls_hi long, cls_lo long, keys array<long>")


def shared_keys(classes: DataFrame, keyed: DataFrame, parts: int) -> DataFrame:
    """``shared_sets`` of ``classes`` (cls_hi, cls_lo, n, members) and their numeric keys in ``keyed`` (cls_hi, cls_lo, keys; a class may come
    twice).  Keys are shuffled once, as arrays: those of a class with the same remainder by ``parts`` are a row, and each remainder is a
    group that counts its keys."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        flat, row = _flat(t["keys"].combine_chunks())
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(start, len(ordered)))
        df = np.repeat(np.where(count > 1, count, 0), count)
        at, df = order[df > 1], df[df > 1]
        by_row = np.argsort(at, kind="stable")
        at, df = at[by_row], df[by_row]
        own, size = np.unique(row[at], return_counts=True)
        rows = pa.array(own)
        yield pa.RecordBatch.from_arrays([*(t[c].take(rows).combine_chunks() for c in CLS), _lists(df.astype(np.int32), size), _lists(flat[at], size)], [*CLS, "df", "h"])

    # hashing is uneven over few groups
    dealt = dealt_keys(keyed, parts).repartition(2 * parts, "p").groupBy("p")
    found = dealt.applyInArrow(run, "cls_hi long, cls_lo long, df array<int>, h array<long>")
    both = F.flatten(F.transform(F.collect_list(F.struct("df", "h")), lambda x: F.arrays_zip(x["df"].alias("df"), x["h"].alias("h"))))
    keys = F.array_distinct(F.transform(F.sort_array(both, asc=False), lambda x: x["h"]))
    return classes.join(found.groupBy(*CLS).agg(keys.alias("keys")), CLS).select(*CLS, "n", "members", "keys")


def across_class_counts(reps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Class pairs that share a shingle, with their members and ``inter``."""
    pairs = self_pairs(class_shingles(reps), ["h"], CLS, ["members"], limit, rank=class_rank())
    return pairs.groupBy(*CLS_PAIR, "members_1", "members_2").agg(F.count(F.lit(1)).alias("inter"))


def within_class_pairs(seats: DataFrame, limit: int = LIMIT) -> DataFrame:
    """File pairs of copies (one class, different submissions); empty files share nothing here."""
    full = seats.where((F.col("members") > 1) & (F.col("n_shingles") > 0))
    p = self_pairs(full, CLS, ["submission_id", "path"], ["n_shingles", "ext"], limit, size="members")
    n = F.col("n_shingles_1")
    return (p.where(F.col("submission_id_1") < F.col("submission_id_2"))
            .select(F.col("submission_id_1").alias("id_a"), F.col("path_1").alias("path_a"),
                    F.col("submission_id_2").alias("id_b"), F.col("path_2").alias("path_b"),
                    n.cast("long").alias("inter"), F.col("ext_1").alias("ext"), n.alias("n_a"), n.alias("n_b")))


def expand_class_pairs(pairs: DataFrame, seats: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs of different classes to the file pairs of their members in different submissions, oriented
    id_a < id_b: (id_a, path_a, id_b, path_b, inter, ext, n_a, n_b).  Output-sized: every row is a file pair of the
    result.  The members of a large class are dealt out by blocks."""
    dealt = blocked(seats, CLS, ["submission_id", "path"], limit, size="members")

    def side(s: str, id_: str, *more) -> DataFrame:
        return dealt.select(*[F.col(c).alias(f"{c}_{s}") for c in CLS], F.col("_t").alias(f"_t{s}"), F.col("submission_id").alias(f"id_{id_}"),
                            F.col("path").alias(f"path_{id_}"), F.col("n_shingles").alias(f"n_{id_}"), *more)

    def blocks(s: str) -> F.Column:
        return F.explode_outer(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(f"members_{s}") / limit).cast("int") - 1, F.lit(0))))

    p = pairs.select(*CLS_PAIR, "members_2", "inter", blocks("1").alias("_t1")).join(side("1", "x", "ext"), ["cls_hi_1", "cls_lo_1", "_t1"])
    p = p.withColumn("_t2", blocks("2")).join(side("2", "y"), ["cls_hi_2", "cls_lo_2", "_t2"])
    x_first = F.col("id_x") < F.col("id_y")

    def pick(c: str, first: str, second: str, name: str) -> F.Column:
        return F.when(x_first, F.col(f"{c}_{first}")).otherwise(F.col(f"{c}_{second}")).alias(name)

    return p.where(F.col("id_x") != F.col("id_y")).select(
        *[pick(c, "x", "y", f"{c}_a") for c in ("id", "path")], *[pick(c, "y", "x", f"{c}_b") for c in ("id", "path")],
        F.col("inter").cast("long").alias("inter"), "ext", pick("n", "x", "y", "n_a"), pick("n", "y", "x", "n_b"))


def shared_shingle_counts(reps: DataFrame, sets: DataFrame, limit: int = LIMIT, shared: DataFrame | None = None,
                          at_least: float = 0.0, blocks: int = 0, keep: Callable[..., DataFrame] | None = None, table: DataFrame | None = None) -> DataFrame:
    """(id_a, path_a, id_b, path_b, inter, ext, n_a, n_b) for every file pair of
    different submissions that shares a shingle (same or different path), or, above zero, whose Jaccard reaches
    ``at_least``; those are found by the prefix filter.  ``shared`` is ``shared_sets(reps)``, if that is written, and ``reps`` needs no keys then; with
    ``blocks`` (``tiles.number_of_blocks(shared, at_least)``) it is counted in tiles, without a shuffle of pairs, from their written ``table`` or one that ``keep`` writes (``tiles.file_pairs``)."""
    seats = class_seats(sets, reps)
    if blocks and shared is not None:
        return tiles.file_pairs(shared, seats, limit, at_least, blocks=blocks, keep=keep, table=table).unionByName(within_class_pairs(seats, limit))
    pairs = class_pairs_at_least(reps, at_least, limit, shared) if at_least > 0 else across_class_counts(reps if shared is None else shared, limit)
    return expand_class_pairs(pairs, seats, limit).unionByName(within_class_pairs(seats, limit))


def same_path_counts(reps: DataFrame, sets: DataFrame, limit: int = LIMIT, shared: DataFrame | None = None) -> DataFrame:
    """The rows of ``shared_shingle_counts`` whose paths are equal, without the others: the files of a path meet, and their shared keys are intersected."""
    shared = reps if shared is None else shared
    p = self_pairs(sets.where(F.col("n_shingles") > 0), ["path"], ["submission_id"], [*CLS, "ext", "n_shingles"], limit)
    copies = (F.col("cls_hi_1") == F.col("cls_hi_2")) & (F.col("cls_lo_1") == F.col("cls_lo_2"))

    def side(s: str) -> DataFrame:
        return shared.select(*[F.col(c).alias(f"{c}_{s}") for c in CLS], F.col("keys").alias(f"k{s}"))

    def rows(pairs: DataFrame, inter) -> DataFrame:
        return pairs.select(F.col("submission_id_1").alias("id_a"), F.col("path").alias("path_a"), F.col("submission_id_2").alias("id_b"),
                            F.col("path").alias("path_b"), inter.cast("long").alias("inter"), F.col("ext_1").alias("ext"),
                            F.col("n_shingles_1").alias("n_a"), F.col("n_shingles_2").alias("n_b"))

    unlike = p.where(~copies).join(side("1"), ["cls_hi_1", "cls_lo_1"]).join(side("2"), ["cls_hi_2", "cls_lo_2"])
    met = rows(unlike, F.size(F.array_intersect("k1", "k2"))).where(F.col("inter") > 0)
    return met.unionByName(rows(p.where(copies), F.col("n_shingles_1")))


def positive_similarities(counts: DataFrame) -> DataFrame:
    """Counted pairs -> (id_a, id_b, path_a, path_b, ext, kind, inter, n_a, n_b, similarity)."""
    return counts.select("id_a", "id_b", "path_a", "path_b", "ext",
                         F.when(F.col("path_a") == F.col("path_b"), "same").otherwise("cross").alias("kind"),
                         F.col("inter").cast("long").alias("inter"), "n_a", "n_b",
                         T.jaccard("inter", "n_a", "n_b").alias("similarity"))


def same_path_pairs(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every common path of two submissions: (id_a, id_b, path, ext, n_a, n_b).
    Output is one row per (path, submission pair) by definition."""
    p = self_pairs(sizes, ["path"], ["submission_id"], ["ext", "n_shingles"], limit)
    return p.select(F.col("submission_id_1").alias("id_a"), F.col("submission_id_2").alias("id_b"), "path",
                    F.col("ext_1").alias("ext"), F.col("n_shingles_1").alias("n_a"), F.col("n_shingles_2").alias("n_b"))


def same_path_similarities(sizes: DataFrame, counts: DataFrame) -> DataFrame:
    """Same-path branch with zeros: common paths left-joined to their counts;
    both empty gives 1.0, one empty 0.0."""
    sp = same_path_pairs(sizes)
    c = (counts.where(F.col("path_a") == F.col("path_b"))
         .select("id_a", "id_b", F.col("path_a").alias("path"), "inter"))
    j = sp.join(c, ["id_a", "id_b", "path"], "left")
    inter = F.coalesce(F.col("inter"), F.lit(0)).cast("long")
    return j.select("id_a", "id_b", F.col("path").alias("path_a"), F.col("path").alias("path_b"), "ext",
                    F.lit("same").alias("kind"), inter.alias("inter"), "n_a", "n_b",
                    T.jaccard(inter, F.col("n_a"), F.col("n_b")).alias("similarity"))


def empty_same_path_pairs(sizes: DataFrame) -> DataFrame:
    """Both-empty common paths (similarity 1.0): they share no shingle, so the
    shingle join cannot see them.  Only empty files take part."""
    sp = same_path_pairs(sizes.where(F.col("n_shingles") == 0))
    return sp.select("id_a", "id_b", F.col("path").alias("path_a"), F.col("path").alias("path_b"), "ext",
                     F.lit("same").alias("kind"), F.lit(0).cast("long").alias("inter"), "n_a", "n_b",
                     F.lit(1.0).alias("similarity"))


def same_path_at_least(sizes: DataFrame, counts: DataFrame, tau: float) -> DataFrame:
    """Same-path similarities >= tau.  Above zero only counted pairs and both-empty ones can
    reach it, so common paths that share nothing are never paired."""
    if tau <= 0:
        return same_path_similarities(sizes, counts)
    same = positive_similarities(counts.where(F.col("path_a") == F.col("path_b")))
    return same.unionByName(empty_same_path_pairs(sizes)).where(F.col("similarity") >= tau)


def all_file_similarities(sizes: DataFrame, counts: DataFrame) -> DataFrame:
    """Union of the same-path branch (zeros included) and cross-path pairs."""
    cross = positive_similarities(counts.where(F.col("path_a") != F.col("path_b")))
    return same_path_similarities(sizes, counts).unionByName(cross)


def common_path_counts(sizes: DataFrame, sub_pairs: DataFrame) -> DataFrame:
    """(id_a, id_b, n_common): number of common kept paths of each given submission pair
    (a keyed lookup per pair instead of all pairs of a path group)."""
    a = (sizes.select(F.col("submission_id").alias("id_a"), "path")
         .join(sub_pairs.select("id_a", "id_b"), "id_a"))
    b = sizes.select(F.col("submission_id").alias("id_b"), "path")
    return a.join(b, ["id_b", "path"]).groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n_common"))


# ---------------------------------------------------------------------------
# Lossless pruning for thresholded queries (prefix + length filter)
# ---------------------------------------------------------------------------

def prefix_length(n, tau: float):
    """Shingles of a set of size n that any tau-similar set must share with
    it: n - ceil(tau * n) + 1 (rounded conservatively)."""
    return n - F.ceil(F.lit(tau) * n - EPS) + 1


def class_pairs_at_least(reps: DataFrame, tau: float, limit: int = LIMIT, shared: DataFrame | None = None) -> DataFrame:
    """Pairs of different classes with Jaccard >= tau > 0, by the prefix filter: each class keeps
    only its rarest shingles (global order by document frequency over
    classes, then key), candidates must share a prefix shingle and pass the
    length filter and the place filter: with r shingles left from the first common one on, no more than the smaller r
    can be common.  Each candidate is verified once by intersecting the
    two arrays of shared keys.  Hot shingles sit at the end of the order and rarely
    enter a prefix; copies are one class, so they never multiply.  Candidates are
    taken with a little slack; the returned rows pass the exact test."""
    if tau <= 0:
        raise ValueError("tau must be > 0")
    shared = shared_sets(reps) if shared is None else shared
    # the frequent stand first, so a key's place is the number of keys from it on to the end of the order
    placed = shared.select(*CLS, "n", F.posexplode_outer("keys").alias("_pos", "h")).withColumn("r", F.col("_pos") + 1)
    prefix = placed.where(F.col("h").isNotNull() & (F.col("r") > F.col("n") - prefix_length(F.col("n"), tau))).select(*CLS, "h", "n", "r")
    lo = F.lit(tau) * F.col("n_1") - EPS
    hi = F.col("n_1") / F.lit(tau) + EPS
    room = F.least("r_1", "r_2") * (1 + tau) >= F.lit(tau) * (F.col("n_1") + F.col("n_2")) - EPS
    cand = (self_pairs(prefix, ["h"], CLS, ["n", "r"], limit, rank=class_rank()).where((F.col("n_2") >= lo) & (F.col("n_2") <= hi) & room)
            .select(*CLS_PAIR).distinct())
    return verified(cand, shared, tau)


def verified(cand: DataFrame, reps: DataFrame, tau: float) -> DataFrame:
    """The class pairs of ``cand`` (distinct) with Jaccard >= tau by their key arrays, with members and ``inter``."""

    def side(s: str) -> DataFrame:
        return reps.select(*[F.col(c).alias(f"{c}_{s}") for c in CLS], F.col("keys").alias(f"k{s}"),
                           F.col("n").alias(f"n_{s}"), F.col("members").alias(f"members_{s}"))

    inter = F.size(F.array_intersect("k1", "k2")).cast("long")
    v = (cand.join(side("1"), ["cls_hi_1", "cls_lo_1"]).join(side("2"), ["cls_hi_2", "cls_lo_2"])
         .select(*CLS_PAIR, "n_1", "n_2", "members_1", "members_2", inter.alias("inter")))
    return v.where(T.jaccard("inter", "n_1", "n_2") >= F.lit(tau))


def pairs_at_least(reps: DataFrame, sets: DataFrame, tau: float, limit: int = LIMIT, shared: DataFrame | None = None, blocks: int = 0, **tiled) -> DataFrame:
    """File pairs (any path, different submissions) with Jaccard >= tau,
    via the class-level prefix filter and the member expansion."""
    if tau <= 0:
        raise ValueError("tau must be > 0")
    return positive_similarities(shared_shingle_counts(reps, sets, limit, shared, tau, blocks, **tiled)).where(F.col("similarity") >= F.lit(tau))


def least_of(tau: float) -> float:
    """``tau`` less a rounding slack."""
    return max(tau - EPS, tau / 2)


def candidate_submission_pairs(reps: DataFrame, sets: DataFrame, tau: float, limit: int = LIMIT, shared: DataFrame | None = None, blocks: int = 0, **tiled) -> DataFrame:
    """Submission pairs that contain a file pair with similarity >= tau, less a rounding slack
    (both-empty common paths count as 1.0).  Any pair whose top-k mean
    reaches tau is among them."""
    found = pairs_at_least(reps, sets, least_of(tau), limit, shared, blocks, **tiled).select("id_a", "id_b")
    return found.unionByName(empty_same_path_pairs(sets).select("id_a", "id_b")).distinct()


def held_by(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """The classes of ``reps`` that have files among ``sets``, with their number of those."""
    return reps.drop("members").join(sets.groupBy(*CLS).agg(F.count(F.lit(1)).alias("members")), CLS)


def counts_of_candidates(reps: DataFrame, sets: DataFrame, candidates: DataFrame, limit: int = LIMIT, shared: DataFrame | None = None, blocks: int = 0, **tiled) -> DataFrame:
    """``shared_shingle_counts`` of the given submission pairs.  Files of submissions without
    a candidate, and classes without such files, leave before the shingle join."""
    ids = candidates.select(F.explode(F.array("id_a", "id_b")).alias("submission_id")).distinct()
    some = sets.join(ids, "submission_id", "left_semi")
    shared = shared if shared is None else held_by(some, shared)
    return shared_shingle_counts(held_by(some, reps), some, limit, shared, blocks=blocks, **tiled).join(candidates, ["id_a", "id_b"], "left_semi")
