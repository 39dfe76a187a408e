"""The operators' queries: each applies its operator to the whole intended table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontam, divergence, lm, mixing, packing, pii, quality, simhash, spelling, token_counts, toxicity, url_rules, warc
from .common import ship_code, table

#: The key of the query's pseudonyms, for test data only: whoever knows the key can undo them.
TEST_KEY = "test key"


def op1_quality_rules(spark, sf_dir):
    return quality.verdicts(table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


def op2_warc_normaliser(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offences").cast("long").alias("n_offences"))


def op5_lm_scoring(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"))


def op6_sequence_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_url_filters(spark, sf_dir):
    found = url_rules.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op8_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_benchmark_decontamination(spark, sf_dir):
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.concat_ws(",", F.sort_array(F.transform("items", lambda i: i.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_pii_pseudonyms(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"), TEST_KEY)


def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_source_mixing(spark, sf_dir):
    return mixing.copies(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def _shipped(query):
    def run(spark, sf_dir):
        ship_code(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_quality_rules, op2_warc_normaliser, op3_token_counts, op4_toxicity, op5_lm_scoring, op6_sequence_packing, op7_url_filters, op8_simhash_near_dedup, op9_benchmark_decontamination, op10_pii_pseudonyms, op11_source_divergence, op12_source_mixing, op13_spelling_variants)}
