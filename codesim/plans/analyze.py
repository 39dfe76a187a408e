"""The whole analysis as one DataFrame plan per result table.

The scan stage normalises, hashes, counts, tokenises and shingles the contents and
keeps narrow facts; contents and normalised text never enter a shuffle.  Shingle keys are
as large as the contents, so they are not written: where they are needed, one file of each
content class is read and shingled again (``keyed``).  With ``persist=True`` (the default) the tables that several results share
are written once to the shared checkpoint folder and read back, which cuts lineage;
``cleanup()`` deletes them.  The session's settings are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, fingerprint, linediff, lsh, report, similarity, template, tiles
from ..params import Params
from ..session import delete, materialise

#: Shingles that one task groups; their number follows the input, a task's memory does not.
SHINGLES_EACH = 2_000_000
#: The same for keys alone, as numbers; class names up to which their list is broadcast, 8 bytes each.
KEYS_EACH, NAMES_MOST = 8_000_000, 1_000_000
#: Similarities at which the search for the best file pairs of each submission pair stops, if it has enough of them by then.
LEVELS = (0.5, 0.1)
SLACK = 1e-9


@dataclass
class Analysis:
    files: DataFrame                       # submission_id, submission, raw_path, content[, entry_ordinal]
    template: DataFrame | None = None      # raw_path, content
    params: Params = Params()
    roster: DataFrame | None = None        # submission_id, submission (submissions without files)
    persist: bool = True
    check_input: bool = True               # reject an empty input (reads at most one row)
    written: list[str] = field(default_factory=list, init=False)
    _blocks: dict[float, int] = field(default_factory=dict, init=False, repr=False)
    _tables: dict[float, DataFrame] = field(default_factory=dict, init=False, repr=False)

    def __post_init__(self):
        source = self.roster if self.roster is not None else self.files
        if self.check_input and source.isEmpty():
            raise ValueError("no submissions given")

    @property
    def spark(self):
        return self.files.sparkSession

    def _keep(self, df: DataFrame, name: str, rows_each: int = 0) -> DataFrame:
        if not self.persist:
            return df
        kept, path = materialise(df, name, rows_each)
        self.written.append(path)
        return kept

    def cleanup(self) -> None:
        """Delete the tables written for this analysis; its results can't be read afterwards."""
        while self.written:
            delete(self.spark, self.written.pop())

    # -- corpus and template ------------------------------------------------
    @cached_property
    def contents(self) -> DataFrame:
        """Admitted files with their contents (lazy)."""
        return corpus.admitted(self.files, self.params)

    @cached_property
    def as_read(self) -> DataFrame:
        """``contents`` where they are read, for what takes few of them."""
        return corpus.admitted(self.files, self.params.with_(scan_partitions=0))

    def _dealt(self, files: DataFrame) -> DataFrame:
        n = self.params.scan_partitions
        return files.repartition(n) if n else files

    @cached_property
    def template_hashes(self) -> DataFrame:
        return template.template_hashes(self.template, self.params, self.spark)

    @cached_property
    def normalized(self) -> DataFrame:
        """Admitted files with ext, norm, norm_hash and n_newlines (lazy, by raw_path)."""
        f = self.contents
        if self.params.compat_strip:
            # the stripped name decides the language, so it must be known before normalising
            return template.normalized(corpus.strip_common_prefix(f, True).withColumn("ext", T.extension("path")))
        # the last component keeps its name when the first is dropped, and so the extension
        return template.normalized(f.withColumn("ext", T.extension("raw_path")))

    def with_paths(self, rows: DataFrame) -> DataFrame:
        """Narrow rows of all admitted files plus their stripped ``path``."""
        return rows if self.params.compat_strip else corpus.strip_common_prefix(rows)

    def _marked(self, scan: DataFrame, *more: str) -> DataFrame:
        path = ["path"] if self.params.compat_strip else []
        narrow = scan.select("submission_id", "submission", "raw_path", *path, "ext", "norm_hash", "n_newlines", *more)
        return template.marked(self.with_paths(narrow), self.template_hashes, self.params)

    @cached_property
    def flags(self) -> DataFrame:
        """Per file: path, ext, norm_hash, n_newlines, is_template, is_kept; nothing is tokenised for it."""
        return self._marked(self.normalized)

    @cached_property
    def scanned(self) -> DataFrame:
        """What one pass over the contents gives: hashes, counts, content class and watch-term counts; shingle keys only where nothing is written."""
        f = report.with_term_counts(self._fingerprinted(self.normalized), self.params, on=self._enough())
        return self._keep(f.drop("content", "norm", *(["keys"] if self.persist else [])), "scanned")

    def _enough(self) -> F.Column:
        return F.col("n_newlines") >= self.params.min_lines

    def _fingerprinted(self, files: DataFrame) -> DataFrame:
        return fingerprint.with_fingerprints(files, self.params, on=self._enough())

    @cached_property
    def facts(self) -> DataFrame:
        """``flags`` plus content class, set size and term counts; no shingle keys."""
        return self._keep(self._marked(self.scanned, "cls_hi", "cls_lo", "n_tokens", "n_shingles", "term_n"), "file_facts")

    @cached_property
    def submissions(self) -> DataFrame:
        roster = self.roster if self.roster is not None else self.files
        known = self.facts if "facts" in self.__dict__ else self.flags
        return template.submissions(roster, known)

    @cached_property
    def kept(self) -> DataFrame:
        """Kept files (not template, long enough)."""
        return self.facts.where(F.col("is_kept"))

    # -- fingerprints -------------------------------------------------------
    @cached_property
    def sets(self) -> DataFrame:
        """Files that take part in comparisons (opt-in token minimum), without their keys."""
        return self._compared().select("submission_id", "path", "ext", "cls_hi", "cls_lo", "n_shingles")

    def _compared(self) -> DataFrame:
        f = self.kept
        return f.where(F.col("n_tokens") >= self.params.min_tokens) if self.params.min_tokens > 0 else f

    @cached_property
    def classes(self) -> DataFrame:
        """One row per content class with its number of shingles and of files; no shingle keys."""
        return self._keep(similarity.content_classes(self.sets), "classes")

    @cached_property
    def keyed(self) -> DataFrame:
        """(cls_hi, cls_lo, keys) of a file of each of ``classes``, of more if names repeat, and of every file where nothing is written (lazy)."""
        if not self.persist:
            return self.scanned.select("cls_hi", "cls_lo", "keys")
        name = F.xxhash64("submission_id", "raw_path")
        names = self._keep(self._compared().groupBy("cls_hi", "cls_lo").agg(F.min(name).alias("_name")).select("_name").distinct(), "class_names")
        if names.count() <= NAMES_MOST:
            names = F.broadcast(names)
        if self.params.compat_strip:
            files = self.normalized.withColumn("_name", name).join(names, "_name", "left_semi")
        else:
            files = self._dealt(self.as_read.withColumn("_name", name).join(names, "_name", "left_semi"))
            files = template.normalized(files.withColumn("ext", T.extension("raw_path")))
        return self._fingerprinted(files).select("cls_hi", "cls_lo", "keys")

    @cached_property
    def reps(self) -> DataFrame:
        """``classes`` with their shingle keys, for what reads all keys more than once."""
        return self._keep(similarity.with_keys(self.classes, self.keyed), "class_sets")

    @cached_property
    def shingle_parts(self) -> int:
        """Partitions that hold about ``SHINGLES_EACH`` shingles of all classes each; 0 where nothing is written and counting would run the scan."""
        return self._parts(SHINGLES_EACH) if self.persist else 0

    def _parts(self, each: int) -> int:
        return -(-(self.classes.agg(F.sum("n")).first()[0] or 0) // each) + self.spark.sparkContext.defaultParallelism

    @cached_property
    def shared(self) -> DataFrame:
        """The class sets without the shingles that stand in one class only.  All keys are read this once, so they are not written by class."""
        keyed = self.reps.select("cls_hi", "cls_lo", "keys") if "reps" in self.__dict__ else self.keyed
        if self.persist and not self.params.exact_keys:
            return self._keep(similarity.shared_keys(self.classes, keyed, self._parts(KEYS_EACH)), "shared_sets")
        return self._keep(similarity.shared_sets(similarity.with_keys(self.classes, keyed), self.shingle_parts), "shared_sets")

    def blocks(self, tau: float = 0.0) -> int:
        """Blocks of the classes that meet in tiles, if they can reach ``tau``; 0 where nothing is written and counting would run the scan."""
        if self.persist and tau not in self._blocks:
            self._blocks[tau] = tiles.number_of_blocks(self.shared, tau)
        return self._blocks.get(tau, 0)

    def table(self, tau: float = 0.0) -> DataFrame | None:
        """The written blocks of all ``sets`` for ``tau``, or of a lower similarity where those are written already; None where nothing is."""
        if not self.persist:
            return None
        known = [t for t in self._tables if t <= tau]
        if not known:
            seats = similarity.class_seats(self.sets, self.classes)
            self._tables[tau] = tiles.stored_blocks(self.shared, seats, self.params.block_rows, tau, self.blocks(tau), self._keep)
        return self._tables[max(known, default=tau)]

    # -- similarities -------------------------------------------------------
    @cached_property
    def counts(self) -> DataFrame:
        """Shared-shingle counts of every file pair."""
        if not self.persist:
            return similarity.shared_shingle_counts(self.reps, self.sets, self.params.block_rows)
        return similarity.shared_shingle_counts(self.classes, self.sets, self.params.block_rows, self.shared, blocks=self.blocks(), table=self.table())

    def counts_at_least(self, tau: float) -> DataFrame:
        """Those of the file pairs that may have a Jaccard of tau > 0 and more, all such pairs among them."""
        return similarity.shared_shingle_counts(self.classes, self.sets, self.params.block_rows, self.shared, tau, self.blocks(tau), table=self.table(tau))

    @cached_property
    def same_path_counts(self) -> DataFrame:
        """Those of the pairs with equal paths."""
        if not self.persist:
            return similarity.same_path_counts(self.reps, self.sets, self.params.block_rows)
        return similarity.same_path_counts(self.classes, self.sets, self.params.block_rows, self.shared)

    def similar(self, tau: float) -> DataFrame:
        """File pairs with Jaccard >= tau > 0."""
        return similarity.pairs_at_least(self.classes, self.sets, tau, self.params.block_rows, self.shared, self.blocks(tau), table=self.table(tau))

    @cached_property
    def file_similarities(self) -> DataFrame:
        """Every file similarity the overall score uses (zeros included)."""
        return similarity.all_file_similarities(self.sets, self.counts)

    @cached_property
    def _scored(self) -> tuple[DataFrame, DataFrame]:
        """(similarities that can be flagged, overall) of the pairs that matter."""
        p = self.params
        empty = similarity.empty_same_path_pairs(self.sets)
        cand = None
        if p.prune and p.overall_thresh > 0:
            least = similarity.least_of(p.overall_thresh)
            cand = self._keep(similarity.candidate_submission_pairs(self.classes, self.sets, p.overall_thresh, p.block_rows, self.shared, self.blocks(least), table=self.table(least)),
                              "candidate_pairs")
            empty = empty.join(cand, ["id_a", "id_b"], "left_semi")
        first = min(LEVELS[0], p.cross_thresh, *([p.file_thresh] if p.file_thresh > 0 else []))
        if self.persist and first > 0:
            pos, sims = self._best(first, empty, cand)
        else:
            counts = self.counts if cand is None else similarity.counts_of_candidates(self.classes, self.sets, cand, p.block_rows, self.shared, self.blocks(), keep=self._keep)
            # two consumers (top-n and counts): write it once instead of running the shingle join twice
            pos = sims = self._keep(similarity.positive_similarities(counts).unionByName(empty), "positive_pairs")
        per_pair = report.pair_counts(sims)
        # common paths matter only where fewer than top_n positives leave room
        # for zeros in the top-n: a keyed lookup for exactly those pairs
        few = per_pair.where(F.col("n_pos") < p.top_n).select("id_a", "id_b")
        common = similarity.common_path_counts(self.sets, few)
        overall = report.overall_from_positive(sims, common, p.top_n, per_pair)
        if p.overall_thresh <= 0:
            everyone = report.all_submission_pairs(self.submissions, p.block_rows)
            overall = (everyone.join(overall, ["id_a", "id_b"], "left")
                       .select("id_a", "id_b", F.coalesce("overall", F.lit(0.0)).alias("overall")))
        return pos, overall

    def _best(self, first: float, empty: DataFrame, cand: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(all similarities >= ``first``, what the overall scores need).  Only a submission pair's ``top_n`` best
        file pairs count, so those above a level are looked for by the prefix filter, and a submission pair that has
        enough of them is done.  The others go on to a lower level; what is left then, and can still reach the
        threshold, is counted in full.  A submission pair's rows come from the level at which it is done."""
        p, ids = self.params, ["id_a", "id_b"]
        keep = ["id_a", "id_b", "kind", "similarity"]

        def settled(sims: DataFrame) -> DataFrame:
            return report.pair_counts(sims).where(F.col("n_pos") >= p.top_n).select(*ids)

        found = self.similar(first)
        found = found if cand is None else found.join(cand, ids, "left_semi")
        pos = self._keep(found.unionByName(empty), "positive_pairs")
        sims, done = [pos.select(*keep)], self._keep(settled(pos), "settled_pairs")
        n_subs = self.sets.select("submission_id").distinct().count()
        wanted = n_subs * (n_subs - 1) // 2 if cand is None else cand.count()
        if done.count() >= wanted:
            return pos, sims[0]
        sims[0] = sims[0].join(done, ids, "left_semi")
        # submissions with all their pairs done leave
        per_sub = done.select(F.explode(F.array(*ids)).alias("submission_id")).groupBy("submission_id").agg(F.count(F.lit(1)).alias("_n"))
        left = self._keep(self.sets.join(per_sub.where(F.col("_n") >= n_subs - 1), "submission_id", "left_anti"), "left_sets")
        reps, shared = self.classes, self._keep(similarity.held_by(left, self.shared), "left_shared_sets")

        def others(rows: DataFrame) -> DataFrame:
            rows = rows.join(done, ids, "left_anti")
            return rows if cand is None else rows.join(cand, ids, "left_semi")

        low = min(LEVELS[1], p.overall_thresh) if p.overall_thresh > 0 else LEVELS[1]
        open_pairs = None
        if low < first:
            next_ = others(similarity.pairs_at_least(reps, left, low, p.block_rows, shared, self.blocks(low), keep=self._keep).unionByName(empty))
            next_ = self._keep(next_.select(*keep), "next_pairs")
            if p.overall_thresh > 0:
                # a pair without any file pair of this level can't reach the threshold; nor can one with a few, if zeros or less fill its mean
                rest = next_.groupBy(*ids).agg(F.count(F.lit(1)).alias("_k"), F.sum("similarity").alias("_sum")).where(F.col("_k") < p.top_n)
                rest = rest.join(similarity.common_path_counts(left, rest), ids, "left")
                size = F.least(F.lit(p.top_n), F.greatest("_k", F.coalesce("n_common", F.lit(0))))
                best = F.when(size >= p.top_n, (F.col("_sum") + (p.top_n - F.col("_k")) * low) / p.top_n).otherwise(F.col("_sum") / F.col("_k"))
                open_pairs = self._keep(rest.where(best >= p.overall_thresh - SLACK).select(*ids), "open_pairs")
                sims.append(next_.join(settled(next_), ids, "left_semi"))
                if open_pairs.isEmpty():
                    return pos, self._keep(sims[0].unionByName(sims[1]), "scored_pairs")
            else:
                more = self._keep(settled(next_), "settled_pairs")
                sims.append(next_.join(more, ids, "left_semi"))
                done = done.unionByName(more)
                if done.count() >= wanted:
                    return pos, self._keep(sims[0].unionByName(sims[1]), "scored_pairs")
        if open_pairs is None:
            rest = others(similarity.positive_similarities(similarity.shared_shingle_counts(reps, left, p.block_rows, shared, blocks=self.blocks(), keep=self._keep)).unionByName(empty))
        else:
            counts = similarity.counts_of_candidates(reps, left, open_pairs, p.block_rows, shared, self.blocks(), keep=self._keep)
            rest = similarity.positive_similarities(counts).unionByName(empty.join(open_pairs, ids, "left_semi"))
        out = rest.select(*keep)
        for s in sims:
            out = out.unionByName(s)
        return pos, self._keep(out, "scored_pairs")

    @cached_property
    def overall(self) -> DataFrame:
        return self._scored[1]

    @cached_property
    def pairs(self) -> DataFrame:
        return report.suspicious(self.overall, self.submissions, self.params)

    @cached_property
    def flagged_files(self) -> DataFrame:
        pos = self._scored[0]
        if self.params.file_thresh <= 0:
            # zero same-path similarities are flagged too: take the full branch
            pos = similarity.same_path_similarities(self.sets, self.same_path_counts).unionByName(
                pos.where(F.col("kind") == "cross"))
        return report.flagged(pos, self.pairs, self.params)

    @cached_property
    def term_counts(self) -> DataFrame:
        if "facts" in self.__dict__:
            return report.term_counts(self.kept, self.submissions, self.params)
        # nothing is tokenised for it
        enough = F.col("n_newlines") >= self.params.min_lines
        scan = report.with_term_counts(self.normalized, self.params, on=enough).drop("content", "norm")
        facts = self._keep(self._marked(scan, "term_n"), "term_facts")
        roster = self.roster if self.roster is not None else self.files
        return report.term_counts(facts.where(F.col("is_kept")), template.submissions(roster, facts), self.params)

    def files_of(self, wanted: DataFrame, source: DataFrame, *cols: str) -> DataFrame:
        """The rows of ``source`` (by raw_path) of the ``wanted`` (submission_id, path), with that path.
        The wanted list is counted and broadcast while it is small, so that ``source``, contents and all, stays
        where it is read."""
        names = wanted.distinct().join(self.facts.select("submission_id", "path", "raw_path"), ["submission_id", "path"])
        names = self._keep(names, "wanted_files")
        if names.count() <= self.params.broadcast_rows:
            names = F.broadcast(names)
        return source.select("submission_id", "raw_path", *cols).join(names, ["submission_id", "raw_path"])

    def flagged_paths(self) -> DataFrame:
        f = self.flagged_files
        return f.select(F.explode(F.array(F.struct(F.col("id_a").alias("submission_id"), F.col("path_a").alias("path")),
                                          F.struct(F.col("id_b").alias("submission_id"), F.col("path_b").alias("path")))).alias("f")).select("f.*")

    @cached_property
    def line_overlap(self) -> DataFrame:
        return report.line_overlap(self.flagged_files, self.flagged_contents)

    @cached_property
    def flagged_contents(self) -> DataFrame:
        """(submission_id, path, content) of the flagged files, each once."""
        return self.files_of(self.flagged_paths(), self.as_read, "content")

    @cached_property
    def line_diff(self) -> DataFrame:
        """The runs of equal, removed and added lines of each flagged file pair."""
        return self._keep(linediff.diff_runs(self.flagged_files, self.flagged_contents), "line_diff")

    @cached_property
    def line_diff_totals(self) -> DataFrame:
        return linediff.diff_totals(self.flagged_files, self.line_diff)

    @cached_property
    def side_by_side(self) -> DataFrame:
        """Each flagged file pair line by line, both texts beside each other."""
        return linediff.side_by_side(self.line_diff, self.flagged_contents)

    @cached_property
    def minhash_estimates(self) -> DataFrame:
        """Flagged file pairs with the Jaccard estimate of their 128-function MinHash signatures."""
        files = self._dealt(self.files_of(self.flagged_paths(), self.as_read, "content"))
        files = template.normalized(files.withColumn("ext", T.extension("path" if self.params.compat_strip else "raw_path")))
        sig = fingerprint.minhash_signatures(files, self.params)
        a = sig.select(F.col("submission_id").alias("id_a"), F.col("path").alias("path_a"), F.col("sig").alias("sig_a"))
        b = sig.select(F.col("submission_id").alias("id_b"), F.col("path").alias("path_b"), F.col("sig").alias("sig_b"))
        j = self.flagged_files.select("id_a", "id_b", "path_a", "path_b", "similarity").join(a, ["id_a", "path_a"]).join(b, ["id_b", "path_b"])
        both_empty = F.col("sig_a").isNull() & F.col("sig_b").isNull()
        return j.select("id_a", "id_b", "path_a", "path_b", "similarity", F.when(both_empty, F.lit(1.0)).otherwise(
            F.coalesce(fingerprint.minhash_estimate("sig_a", "sig_b"), F.lit(0.0))).alias("estimate"))

    @cached_property
    def tfidf(self) -> DataFrame:
        """TF-IDF weights of the kept code of every submission."""
        kept = self.kept.select("submission_id", "raw_path")
        return self._keep(fingerprint.tfidf_weights(self._keep(fingerprint.token_counts(self.normalized, kept), "token_counts")), "tfidf")

    def _cosines(self, pairs: DataFrame) -> DataFrame:
        """Cosines of the pairs, which are counted and broadcast while they are few."""
        pairs = self._keep(pairs, "cosine_candidates")
        few = self.persist and pairs.count() <= self.params.broadcast_rows
        return fingerprint.cosines(self.tfidf, pairs, self.params.block_rows, few)

    @cached_property
    def tfidf_cosine(self) -> DataFrame:
        """TF-IDF cosine of the kept code of the reported pairs."""
        return self._cosines(self.pairs.select("id_a", "id_b"))

    def cosine_pairs(self, tau: float) -> DataFrame:
        """All submission pairs whose TF-IDF cosine reaches ``tau``, reported or not."""
        return self._cosines(fingerprint.cosine_candidates(self.tfidf, tau, self.params.block_rows)).where(F.col("cosine") >= F.lit(tau))

    def similar_by_bands(self, tau: float, recall: float = 0.995) -> DataFrame:
        """File pairs with Jaccard >= tau found by MinHash bands: an approximate search, exact rows (``operators.lsh``)."""
        return lsh.pairs_at_least(self.reps, self.sets, tau, recall, self.params.block_rows, self.shared, self.blocks(tau), self._keep)

    @cached_property
    def summary(self) -> DataFrame:
        n = F.count(F.lit(1))
        s = self.submissions.agg(n.alias("n_submissions"),
                                 F.avg("template_pct").alias("avg_template_pct"))
        # the other counters are scalar subqueries of their own tables
        return s.select(
            self.template_hashes.agg(n).scalar().cast("long").alias("template_hashes"),
            F.col("n_submissions").cast("long").alias("n_submissions"),
            (F.col("n_submissions") * (F.col("n_submissions") - 1) / 2).cast("long").alias("total_pairs"),
            self.pairs.agg(n).scalar().cast("long").alias("kept_pairs"),
            self.flagged_files.agg(n).scalar().cast("long").alias("flagged_files"),
            "avg_template_pct")

    def tables(self) -> dict[str, DataFrame]:
        self.overall  # the shared tables first
        return {"submissions": self.submissions, "term_counts": self.term_counts,
                "pairs": self.pairs, "flagged_files": self.flagged_files,
                "line_overlap": self.line_overlap, "summary": self.summary}


def analyze(files: DataFrame, template: DataFrame | None = None, roster: DataFrame | None = None,
            persist: bool = True, **params) -> Analysis:
    """Public entry: build the analysis plan for ``files`` (and template)."""
    return Analysis(files, template, Params(**params), roster, persist)
