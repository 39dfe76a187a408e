"""Fingerprints: tokens, k-shingle sets, content classes, MinHash signatures and TF-IDF vectors.

A shingle key is a 64-bit hash of (ext, shingle text), so an equi-join on it pairs only files
of the same extension; ``Params.exact_keys`` keys on the text instead, for corpora with so many
distinct shingles that 64-bit collisions matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..params import Params
from .blocks import LIMIT, self_pairs

#: MinHash: 128 functions (a * x + b) mod 2^31 - 1 of a 31-bit hash x; a and b follow from the function's number.
N_HASHES = 128
PRIME = 2**31 - 1


def hash_parameters(n: int = N_HASHES) -> list[tuple[int, int]]:
    return [(1 + (1103515245 * (i + 1) + 12345) % (PRIME - 1), (69069 * (i + 1) * (i + 1) + 1) % PRIME) for i in range(n)]


def content_class(ext, norm_hash) -> tuple[F.Column, F.Column]:
    """120-bit id of (extension, normalised text): files with the same id have
    the same shingle set.  Two 60-bit slices of a SHA-256, so ids are plain
    longs in the join tables."""
    digest = F.sha2(F.concat_ws(":", ext, norm_hash), 256)
    hi = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    lo = F.conv(F.substring(digest, 16, 15), 16, 10).cast("long")
    return hi, lo


def with_fingerprints(files: DataFrame, params: Params, on=None) -> DataFrame:
    """Add cls_hi, cls_lo, n_tokens, keys and n_shingles to files carrying
    ``norm``, ``norm_hash`` and ``ext``; rows where ``on`` is false get nulls
    (no shingling of short files)."""
    k = params.shingle_size
    on = F.lit(True) if on is None else on
    hi, lo = content_class(F.col("ext"), F.col("norm_hash"))
    # tokens get their own projection: referenced from inside the shingle
    # lambda, an inline token expression would be re-run per shingle
    f = (files.withColumn("cls_hi", hi).withColumn("cls_lo", lo)
         .withColumn("_tok", F.when(on, T.tokens("norm"))))
    texts = T.shingle_texts(F.col("_tok"), k)
    keys = F.array_distinct(F.transform(texts, lambda s: T.shingle_key(F.col("ext"), s, params.exact_keys)))
    return (f.withColumn("keys", F.when(F.col("_tok").isNotNull(), keys))
            .withColumn("n_tokens", F.when(F.col("_tok").isNotNull(), F.size("_tok").cast("long")))
            .withColumn("n_shingles", F.when(F.col("keys").isNotNull(), F.size("keys").cast("long")))
            .drop("_tok"))


def shingle_df(reps: DataFrame, parts: int = 0) -> DataFrame:
    """Document frequency of each shingle key over files (the inverted index, counted).  Most shingles are of one class, so counting
    before the shuffle would only fill a table: they are dealt to ``parts`` partitions first (0: the session's)."""
    from .similarity import class_shingles

    sh = class_shingles(reps)
    return (sh.repartition(parts, "h") if parts else sh).groupBy("h").agg(F.sum("members").cast("long").alias("df"))


def minhash_signatures(files: DataFrame, params: Params) -> DataFrame:
    """(submission_id, path, ext, norm) to (submission_id, path, sig): 128 minima, null for a file without shingles.
    The shingles of a file lie in one row, so the partial aggregate shrinks them to one row before the shuffle."""
    toks = files.select("submission_id", "path", "ext", T.tokens("norm").alias("_tok"))
    sh = toks.select("submission_id", "path", T.explode_rows(
        F.transform(T.shingle_texts("_tok", params.shingle_size),
                    lambda s: F.conv(F.substring(F.md5(F.concat_ws(" ", F.col("ext"), s)), 1, 8), 16, 10).cast("long").bitwiseAND(PRIME))).alias("x"))
    minima = [F.min(F.pmod(F.col("x") * a + b, F.lit(PRIME))) for a, b in hash_parameters()]
    return sh.groupBy("submission_id", "path").agg(F.array(*minima).alias("m")).select(
        "submission_id", "path", F.when(F.element_at("m", 1).isNotNull(), F.col("m")).alias("sig"))


def minhash_estimate(a, b) -> F.Column:
    """Share of equal minima."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(N_HASHES))


def token_counts(files: DataFrame, kept: DataFrame) -> DataFrame:
    """(submission_id, token, tf): the tokens of the ``kept`` (submission_id, raw_path) files, counted by file where ``files`` (submission_id,
    raw_path, norm) are read."""
    by_file = (files.select("submission_id", "raw_path", T.explode_rows(T.tokens("norm")).alias("token")).where(F.col("token").isNotNull())
               .groupBy("submission_id", "raw_path", "token").agg(F.count(F.lit(1)).alias("c")))
    return by_file.join(kept, ["submission_id", "raw_path"], "left_semi").groupBy("submission_id", "token").agg(F.sum("c").alias("tf"))


def tfidf_weights(tf: DataFrame) -> DataFrame:
    """(submission_id, token, w, df): the TF-IDF weights of ``token_counts``, which are read three times; tf is the count,
    idf = ln((1 + N) / (1 + df)) + 1 over the N submissions that have tokens."""
    n = tf.agg(F.countDistinct("submission_id")).scalar()
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1
    return tf.join(df, "token").select("submission_id", "token", (F.col("tf") * idf).alias("w"), "df")


def cosines(weights: DataFrame, pairs: DataFrame, limit: int = LIMIT, few: bool = False) -> DataFrame:
    """(id_a, id_b, cosine) of ``pairs`` (id_a < id_b) from ``tfidf_weights``; only tokens of submissions in ``pairs`` are joined.  A pair without
    common token gets 0.0.  Weights of a token meet and are summed by pair in the task that joins them, so that weights are shuffled, and
    one sum a pair and task; with ``few`` pairs, which are broadcast, no other pair is summed."""
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("submission_id")).distinct()
    w = weights.join(ids, "submission_id", "left_semi")
    norms = w.groupBy("submission_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # a pair that is given twice counts twice
    wanted = pairs.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("_times"))
    met = self_pairs(w.select("submission_id", "token", "w"), ["token"], ["submission_id"], ["w"], limit).select(
        F.col("submission_id_1").alias("id_a"), F.col("submission_id_2").alias("id_b"), "w_1", "w_2")
    met = met.join(F.broadcast(wanted) if few else wanted, ["id_a", "id_b"])
    dot = met.groupBy("id_a", "id_b").agg((F.sum(F.col("w_1") * F.col("w_2")) * F.first("_times")).alias("dot"))
    na = norms.select(F.col("submission_id").alias("id_a"), F.col("norm").alias("norm_a"))
    nb = norms.select(F.col("submission_id").alias("id_b"), F.col("norm").alias("norm_b"))
    out = pairs.select("id_a", "id_b").join(dot, ["id_a", "id_b"], "left").join(na, "id_a", "left").join(nb, "id_b", "left")
    return out.select("id_a", "id_b", F.coalesce(F.col("dot") / (F.col("norm_a") * F.col("norm_b")), F.lit(0.0)).alias("cosine"))


def cosine_candidates(weights: DataFrame, tau: float, limit: int = LIMIT) -> DataFrame:
    """(id_a, id_b), id_a < id_b: a superset of the pairs with cosine >= tau > 0, from (submission_id, token, w, df).

    Every vector's tokens stand in one order, the frequent before the rare.  Its first tokens, as long as they weigh less
    than ``tau`` of its length together, are left out of the index: if two vectors had only such tokens of one of them in common, their
    cosine would be under ``tau`` (Cauchy-Schwarz).  The rarest common token of a pair that reaches ``tau`` is therefore in the index of
    both, so only rows with equal indexed tokens meet, and the frequent tokens hardly ever do."""
    if tau <= 0:
        raise ValueError("tau must be > 0")
    square = F.col("w") * F.col("w")
    mine = Window.partitionBy("submission_id")
    up_to = F.sum(square).over(mine.orderBy(F.desc("df"), "token").rowsBetween(Window.unboundedPreceding, 0))
    # a little slack for sums in another order
    indexed = weights.withColumn("_to", up_to / F.sum(square).over(mine)).where(F.col("_to") >= tau * tau - 1e-9)
    pairs = self_pairs(indexed.select("submission_id", "token"), ["token"], ["submission_id"], limit=limit)
    return pairs.select(F.col("submission_id_1").alias("id_a"), F.col("submission_id_2").alias("id_b")).distinct()


def cosine_at_least(weights: DataFrame, tau: float, limit: int = LIMIT) -> DataFrame:
    """(id_a, id_b, cosine) of all pairs with cosine >= tau, from ``tfidf_weights``; exact, without forming all pairs."""
    return cosines(weights, cosine_candidates(weights, tau, limit), limit).where(F.col("cosine") >= F.lit(tau))
