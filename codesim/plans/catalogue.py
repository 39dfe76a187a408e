"""Query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per operator
group, all over the code-like view of the whole ``documents`` table
(``sources.fixture``).  Doubles are rounded to 6 digits at the end of each
query so they compare with an independent engine; counts are ``bigint``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import decode
from ..functions import text as T
from ..operators import corpus, fingerprint, index, report, similarity, template
from ..params import Params
from ..session import checkpoint_root, materialise
from ..sources import archives, fixture, zipsplit
from ..sources.sinks import pair_report
from .analyze import Analysis

# Fixed values of the fixture run (FIXTURES.md section 2).
FIXTURE_TERMS = ("the", "license", "token", "error")
FIXTURE = Params(terms=FIXTURE_TERMS, overall_thresh=0.1)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def _analysis(spark: SparkSession, sf: str, params: Params = FIXTURE, n_submissions: int = fixture.N_SUBMISSIONS) -> Analysis:
    params = params.with_(scan_partitions=fixture.to_deal(spark, sf))
    return Analysis(fixture.submission_files(spark, sf, n_submissions=n_submissions),
                    fixture.template_files(spark, sf, n_submissions=n_submissions), params)


# -- corpus ----------------------------------------------------------------

def files_admitted(spark, sf):
    f = corpus.admit(fixture.code_files(spark, sf), FIXTURE)
    return f.select("submission_id", "raw_path", T.extension("raw_path").alias("ext"))


def paths_stripped(spark, sf):
    f = corpus.admit(fixture.submission_files(spark, sf), FIXTURE).select("submission_id", "raw_path")
    return corpus.strip_common_prefix(f).withColumn("ext", T.extension("path"))


def duplicate_entries_last_wins(spark, sf):
    f = corpus.last_entry_wins(fixture.code_files(spark, sf, with_revisions=True))
    return f.select("submission_id", "raw_path", F.sha2("content", 256).alias("content_sha"),
                    F.length("content").cast("long").alias("n_chars"))


def _normalized(spark, sf, py: bool):
    a = _analysis(spark, sf)
    f = a.normalized.select("submission_id", "raw_path", "ext", F.md5("norm").alias("norm_md5"),
                            F.length("norm").cast("long").alias("norm_len"))
    f = a.with_paths(f).where((F.col("ext") == "py") if py else (F.col("ext") != "py"))
    return f.select("submission_id", "path", "norm_md5", "norm_len")


def normalized_py(spark, sf):
    return _normalized(spark, sf, True)


def normalized_c(spark, sf):
    return _normalized(spark, sf, False)


def norm_hash(spark, sf):
    return _analysis(spark, sf).flags.select("submission_id", "path", "norm_hash")


def tokens_per_file(spark, sf):
    a = _analysis(spark, sf)
    tok = a.normalized.select("submission_id", "raw_path", T.tokens("norm").alias("tok"))
    tok = tok.select("submission_id", "raw_path", F.size("tok").cast("long").alias("n_tokens"),
                     F.md5(F.array_join("tok", " ")).alias("tokens_md5"))
    return a.with_paths(tok).select("submission_id", "path", "n_tokens", "tokens_md5")


def shingles_per_file(spark, sf):
    return _analysis(spark, sf).sets.select("submission_id", "path", "n_shingles")


def shingle_df(spark, sf):
    """How many distinct shingles have each document frequency."""
    a = _analysis(spark, sf)
    df = fingerprint.shingle_df(a.reps, a.shingle_parts)
    return df.groupBy("df").agg(F.count(F.lit(1)).alias("n_shingles"))


def archive_expand(spark, sf):
    """Every document packed into a zip archive, numbered by path and expanded by the archive source."""
    blobs = fixture.archive_blobs(spark, sf)
    names = archives.numbered(blobs.select("path"))
    e = archives.expand(blobs, FIXTURE).join(names, "path")
    return e.select("submission_id", "submission", "raw_path", F.col("entry_ordinal").cast("long").alias("entry_ordinal"),
                    F.sha2(archives.text_of("data"), 256).alias("content_sha"))


def archive_expand_split(spark, sf):
    """The documents in archives of many entries each, read back by offset ranges."""
    folder = f"{checkpoint_root(spark).rstrip('/')}/zips-{uuid.uuid4().hex}"
    fixture.archive_folder(spark, sf, folder)
    e = zipsplit.expand(spark, folder, FIXTURE)
    return e.select(archives.archive_stem(F.col("path")).alias("submission"), "raw_path", F.col("entry_ordinal").cast("long").alias("entry_ordinal"),
                    F.sha2(archives.text_of("data"), 256).alias("content_sha"))


def charset_detected(spark, sf):
    """The documents in six encodings: the character set told by the bytes, and the text in it."""
    e = fixture.encoded(spark, sf)
    return e.select("doc_id", decode.charset("data").alias("charset"), F.sha2(decode.decoded("data"), 256).alias("text_sha"))


# -- template --------------------------------------------------------------

def template_hashes(spark, sf):
    return _analysis(spark, sf).template_hashes


def template_hashes_repeated(spark, sf):
    """A template whose names come twice: the hashes of all entries."""
    return template.template_hashes(fixture.template_files(spark, sf, with_revisions=True), FIXTURE, spark)


def template_subtracted(spark, sf):
    f = _analysis(spark, sf).flags.where(~F.col("is_template"))
    return f.select("submission_id", "path", "n_newlines")


def template_matched(spark, sf):
    f = _analysis(spark, sf).flags.where(F.col("is_template"))
    return f.select("submission_id", "path", "norm_hash")


def files_removed(spark, sf):
    f = _analysis(spark, sf).flags.where(~F.col("is_kept"))
    reason = F.when(F.col("is_template"), "template").otherwise("short")
    return f.select("submission_id", "path", reason.alias("reason"))


def min_lines_kept(spark, sf):
    return _analysis(spark, sf).flags.where("is_kept").select("submission_id", "path", "n_newlines")


def submission_overview(spark, sf):
    return rounded(_analysis(spark, sf).submissions)


def term_counts(spark, sf):
    return _analysis(spark, sf).term_counts


def term_counts_many(spark, sf):
    """All 676 two-letter terms, counted by one automaton."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms = tuple(a + b for a in letters for b in letters)
    return _analysis(spark, sf, FIXTURE.with_(terms=terms)).term_counts.where(F.col("n") > 0)


def term_counts_wide(spark, sf):
    return report.term_counts_wide(_analysis(spark, sf).term_counts, FIXTURE_TERMS)


# -- similarities ----------------------------------------------------------

def _same(s: DataFrame) -> DataFrame:
    return rounded(s.select("id_a", "id_b", F.col("path_a").alias("path"), "inter", "n_a", "n_b", "similarity"))


def same_path_similarity(spark, sf):
    a = _analysis(spark, sf)
    return _same(similarity.same_path_similarities(a.sets, a.same_path_counts))


def same_path_flagged(spark, sf):
    a = _analysis(spark, sf)
    return _same(similarity.same_path_at_least(a.sets, a.counts_at_least(FIXTURE.file_thresh), FIXTURE.file_thresh))


def cross_path_candidates(spark, sf):
    c = _analysis(spark, sf).counts
    return c.where(F.col("path_a") != F.col("path_b")).select("id_a", "path_a", "id_b", "path_b",
                                                             F.col("inter").cast("long"))


def _cross(counts: DataFrame) -> DataFrame:
    return similarity.positive_similarities(counts.where(F.col("path_a") != F.col("path_b")))


def counts_by_index(spark, sf):
    """Shared-shingle counts of all file pairs: submissions 2 to 14 stand in a stored index, 15 to 19 are joined with it and added."""
    params = FIXTURE.with_(scan_partitions=fixture.to_deal(spark, sf))
    files, template_ = fixture.submission_files(spark, sf), fixture.template_files(spark, sf)
    old, new = (Analysis(files.where(c), template_, params) for c in ("submission_id < 15", "submission_id >= 15"))
    at = index.build(spark, f"{checkpoint_root(spark).rstrip('/')}/index-{uuid.uuid4().hex}", old.sets, old.reps, buckets=16, limit=params.block_rows)
    counts = old.counts.select(*index.COUNTS).unionByName(at.counts_added(new.sets, new.reps))
    return counts.select("id_a", "path_a", "id_b", "path_b", F.col("inter").cast("long").alias("inter"))


def cross_path_similarity(spark, sf):
    s = _cross(_analysis(spark, sf).counts)
    return rounded(s.select("id_a", "path_a", "id_b", "path_b", "inter", "n_a", "n_b", "similarity"))


def cross_path_flagged(spark, sf):
    s = _cross(_analysis(spark, sf).counts_at_least(FIXTURE.cross_thresh)).where(F.col("similarity") >= FIXTURE.cross_thresh)
    return rounded(s.select("id_a", "path_a", "id_b", "path_b", "similarity"))


def cross_path_flagged_pruned(spark, sf):
    """Same result through the prefix + length filter (no full self-join)."""
    a = _analysis(spark, sf)
    s = a.similar(FIXTURE.cross_thresh)
    s = s.where(F.col("kind") == "cross")
    return rounded(s.select("id_a", "path_a", "id_b", "path_b", "similarity"))


def all_file_similarities(spark, sf):
    s = _analysis(spark, sf).file_similarities
    return rounded(s.select("id_a", "id_b", "path_a", "path_b", "kind", "similarity"))


def _named_pairs(roster: DataFrame) -> DataFrame:
    p = report.all_submission_pairs(roster, FIXTURE.block_rows)
    return (p.join(roster.select(F.col("submission_id").alias("id_a"), F.col("submission").alias("submission_a")), "id_a")
            .join(roster.select(F.col("submission_id").alias("id_b"), F.col("submission").alias("submission_b")), "id_b")
            .select("id_a", "id_b", "submission_a", "submission_b"))


def submission_pairs(spark, sf):
    return _named_pairs(_analysis(spark, sf).submissions)


def submission_pairs_sparse_ids(spark, sf):
    """All pairs for ids that are unique but not dense."""
    roster = fixture.submission_files(spark, sf).select("submission_id", "submission").distinct()
    return _named_pairs(roster.withColumn("submission_id", F.col("submission_id") * 7 + 3))


def overall_similarity(spark, sf):
    """Overall score of every submission pair (0.0 without file pairs)."""
    a = _analysis(spark, sf, FIXTURE.with_(overall_thresh=0.0))
    return rounded(a.overall.select("id_a", "id_b", "overall"))


def suspicious_pairs(spark, sf):
    return rounded(_analysis(spark, sf).pairs)


def suspicious_pairs_pruned(spark, sf):
    """The flagship through lossless submission-pair pruning (forced on)."""
    return rounded(_analysis(spark, sf, FIXTURE.with_(prune=True)).pairs)


def _many(spark, sf, prune):
    return rounded(_analysis(spark, sf, FIXTURE.with_(prune=prune, overall_thresh=0.4), n_submissions=200).pairs)


def suspicious_pairs_many(spark, sf):
    """The flagship over 200 small submissions."""
    return _many(spark, sf, False)


def suspicious_pairs_many_pruned(spark, sf):
    return _many(spark, sf, True)


def positions(pairs: DataFrame) -> DataFrame:
    """Numbered as the archives are: sorted by range and written once, a position is the partition's offset plus the rank within it."""
    order = (F.desc("overall"), F.col("id_a"), F.col("id_b"))
    ordered, _ = materialise(pairs.select("id_a", "id_b", "overall").orderBy(*order).withColumn("_p", F.spark_partition_id()), "pair_order")
    sizes = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row per partition
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ordered.withColumn("_r", rank).join(before, "_p").select("id_a", "id_b", (F.col("_before") + F.col("_r")).cast("long").alias("position"))


def suspicious_pairs_order(spark, sf):
    """The position of every reported pair."""
    return positions(_analysis(spark, sf).pairs)


def minhash_signature(spark, sf):
    """Digest of the 128 minima of every kept file."""
    a = _analysis(spark, sf)
    kept = a.flags.where("is_kept").select("submission_id", "raw_path", "path")
    sig = fingerprint.minhash_signatures(a.normalized.select("submission_id", F.col("raw_path").alias("path"), "ext", "norm").where(F.col("n_newlines") >= FIXTURE.min_lines), FIXTURE)
    out = sig.withColumnRenamed("path", "raw_path").join(kept, ["submission_id", "raw_path"])
    return out.select("submission_id", "path", F.md5(F.array_join(F.transform("sig", lambda x: x.cast("string")), ",")).alias("sig_md5"))


def minhash_estimate(spark, sf):
    """Jaccard estimates of the flagged file pairs."""
    return rounded(_analysis(spark, sf).minhash_estimates.select("id_a", "id_b", "path_a", "path_b", "estimate"))


def tfidf_cosine(spark, sf):
    """TF-IDF cosine of the kept code of the reported pairs."""
    return rounded(_analysis(spark, sf).tfidf_cosine)


def cosine_pairs(spark, sf):
    """All pairs of 200 small submissions with a TF-IDF cosine of at least 0.5, by an inverted index."""
    return rounded(_analysis(spark, sf, n_submissions=200).cosine_pairs(0.5))


def cross_path_flagged_bands(spark, sf):
    """``cross_path_flagged`` by MinHash bands."""
    s = _analysis(spark, sf).similar_by_bands(FIXTURE.cross_thresh).where(F.col("kind") == "cross")
    return rounded(s.select("id_a", "path_a", "id_b", "path_b", "similarity"))


def bands_recall(spark, sf):
    """How many file pairs of similarity 0.5 and more there are (the exact way), and whether the bands find nine tenths of them."""
    a = _analysis(spark, sf)
    pair = ["id_a", "path_a", "id_b", "path_b"]
    found = a.similar_by_bands(0.5).select(*pair, F.lit(1).alias("hit"))  # first, as it has all keys written by class
    exact = a.similar(0.5).select(*pair)
    n, hits = F.count(F.lit(1)), F.count("hit")
    return exact.join(found, pair, "left").agg(n.alias("n_exact"), (10 * hits >= 9 * n).alias("found_nine_tenths"))


def flagged_files_top20(spark, sf):
    return rounded(_analysis(spark, sf).flagged_files)


def pair_report_nested(spark, sf):
    """One row per suspicious pair with its flagged files folded in rank order."""
    a = _analysis(spark, sf)
    j = pair_report(a.pairs, a.flagged_files)
    files = F.array_join(F.transform("flagged_files", lambda x: F.concat(x["path_a"], F.lit(">"), x["path_b"])), ";")
    return rounded(j.select("id_a", "id_b", "submission_a", "submission_b", "overall", "severity",
                            F.size("flagged_files").cast("long").alias("n_flagged"), files.alias("flagged"),
                            F.array_max(F.transform("flagged_files", lambda x: x["similarity"])).alias("max_file_similarity")))


def line_overlap(spark, sf):
    return _analysis(spark, sf).line_overlap


def line_diff(spark, sf):
    """Equal, removed and added lines of each flagged file pair along a longest common subsequence."""
    return _analysis(spark, sf).line_diff_totals.drop("n_runs")


def line_diff_view(spark, sf):
    """The side-by-side view of each flagged file pair, digested: how many lines each column holds, and both files as the
    columns spell them, which must be the files themselves; equal lines have equal texts."""
    key = ["id_a", "id_b", "path_a", "path_b"]
    view = _analysis(spark, sf).side_by_side

    def column(s: str) -> list:
        lines = F.sort_array(F.collect_list(F.when(F.col(f"line_{s}").isNotNull(), F.struct(f"line_{s}", f"text_{s}"))))
        return [F.count(f"line_{s}").alias(f"lines_{s}"), F.md5(F.array_join(F.transform(lines, lambda x: x[f"text_{s}"]), "\n")).alias(f"md5_{s}")]

    same = F.sum(F.when((F.col("kind") == "equal") & ~F.col("text_a").eqNullSafe(F.col("text_b")), 1).otherwise(0)).cast("long")
    return view.groupBy(*key).agg(*column("a"), *column("b"), same.alias("unlike"))


def run_summary(spark, sf):
    return rounded(_analysis(spark, sf).summary)


def similarity_filter(spark, sf):
    """Re-filter stored pairs at a stricter overall threshold."""
    return suspicious_pairs(spark, sf).where(F.col("overall") >= 0.2)


def few_token_filter(spark, sf):
    """Suspicious pairs when kept files need at least 200 tokens."""
    return rounded(_analysis(spark, sf, FIXTURE.with_(min_tokens=200)).pairs)


QUERIES = {
    "files_admitted": files_admitted,
    "paths_stripped": paths_stripped,
    "duplicate_entries_last_wins": duplicate_entries_last_wins,
    "archive_expand": archive_expand,
    "archive_expand_split": archive_expand_split,
    "charset_detected": charset_detected,
    "normalized_py": normalized_py,
    "normalized_c": normalized_c,
    "norm_hash": norm_hash,
    "tokens_per_file": tokens_per_file,
    "shingles_per_file": shingles_per_file,
    "shingle_df": shingle_df,
    "template_hashes": template_hashes,
    "template_hashes_repeated": template_hashes_repeated,
    "template_subtracted": template_subtracted,
    "template_matched": template_matched,
    "files_removed": files_removed,
    "min_lines_kept": min_lines_kept,
    "submission_overview": submission_overview,
    "term_counts": term_counts,
    "term_counts_wide": term_counts_wide,
    "term_counts_many": term_counts_many,
    "same_path_similarity": same_path_similarity,
    "same_path_flagged": same_path_flagged,
    "cross_path_candidates": cross_path_candidates,
    "counts_by_index": counts_by_index,
    "cross_path_similarity": cross_path_similarity,
    "cross_path_flagged": cross_path_flagged,
    "cross_path_flagged_pruned": cross_path_flagged_pruned,
    "all_file_similarities": all_file_similarities,
    "submission_pairs": submission_pairs,
    "submission_pairs_sparse_ids": submission_pairs_sparse_ids,
    "overall_similarity": overall_similarity,
    "suspicious_pairs": suspicious_pairs,
    "suspicious_pairs_pruned": suspicious_pairs_pruned,
    "suspicious_pairs_many": suspicious_pairs_many,
    "suspicious_pairs_many_pruned": suspicious_pairs_many_pruned,
    "suspicious_pairs_order": suspicious_pairs_order,
    "flagged_files_top20": flagged_files_top20,
    "pair_report_nested": pair_report_nested,
    "line_overlap": line_overlap,
    "line_diff": line_diff,
    "line_diff_view": line_diff_view,
    "minhash_signature": minhash_signature,
    "minhash_estimate": minhash_estimate,
    "tfidf_cosine": tfidf_cosine,
    "cosine_pairs": cosine_pairs,
    "cross_path_flagged_bands": cross_path_flagged_bands,
    "bands_recall": bands_recall,
    "run_summary": run_summary,
    "similarity_filter": similarity_filter,
    "few_token_filter": few_token_filter,
}
