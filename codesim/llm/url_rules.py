"""URL filters by association rules.  DataFrame functions and Spark ML's FP-growth only.

A url is a set of tokens: its host labels (and their hyphenated parts), path segments, file ending and query keys, numbers being one token.
Labelled pages become transactions of their tokens and their label; FP-growth finds the token combinations that come
with the bad label, and rules "tokens -> bad" of enough support and confidence stay, unless a rule on fewer of the same
tokens is as confident.  Tokens that stand in exactly the same labelled pages are mined as one, and a rule asks for any of
them, which is what the rules on each of them would do together.  Rules are matched by an inverted index: each is filed under its rarest tokens, a page's
tokens are joined with that index, and the few candidates are checked in full.  The index is broadcast while it has at most
``max_broadcast`` rules; beyond that the same join is shuffled.

A list of given rules (host and path prefix) comes first: the longest that fits a url decides, the mined rules decide the rest.

Defined results: a null url, or one without ``://``, has empty host and path, no tokens, no rule, and is allowed; repeated rows get
equal answers; without labels of both kinds nothing is mined; labels without page, and null labels, are ignored; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: The given rules: (host and path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """The distinct tokens, each led by its kind."""
    lead = lambda kind, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind), F.when(p.rlike("^[0-9]+$"), F.lit("#")).otherwise(p)))
    name = F.regexp_replace(host(url), ":[0-9]*$", "")
    labels = F.split(name, r"\.")
    hyphened = F.filter(F.split(name, "[.-]"), lambda p: ~F.array_contains(labels, p))
    segments = F.split(F.regexp_replace(path(url), r"\.[A-Za-z0-9]{1,5}$", ""), "/")
    ending = F.array(F.regexp_extract(path(url), r"\.([A-Za-z0-9]{1,5})$", 1))
    keys = F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), F.lit(r"([^&=]+)(?:=[^&]*)?"), F.lit(1))
    return F.array_distinct(F.concat(lead("host:", labels), lead("part:", hyphened), lead("path:", segments), lead("file:", ending), lead("query:", keys)))


def given(url_host: Column, url_path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = None
    for text, decision in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((url_host == name) | F.endswith(url_host, F.lit(f".{name}"))) & F.startswith(url_path, F.lit(slash + rest))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def twins(baskets: DataFrame, least: float) -> DataFrame:
    """rep, any_of (sorted array of tokens, rep first), n: the tokens that stand in exactly the same rows of ``baskets`` (row, tokens), for
    those of at least ``least`` rows.  Equal sets of rows are told by their number and two 64-bit sums of row hashes; as the tokens of
    an array share a row, it is no longer than a url has tokens."""
    held = baskets.select("row", F.explode("tokens").alias("token")).groupBy("token")
    marks = held.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y")).where(F.col("n") >= least)
    return marks.groupBy("n", "x", "y").agg(F.sort_array(F.collect_list("token")).alias("any_of")).select(F.element_at("any_of", 1).alias("rep"), "any_of", "n")


def mined(labelled: DataFrame, support: float = 0.001, confidence: float = 0.8, max_broadcast: int = 100_000) -> DataFrame:
    """Rules (antecedent, confidence, support, any_of, anchors) from (tokens, bad boolean): a token of the antecedent stands for
    any of the tokens in its array of ``any_of``; ``anchors`` is the array of the rarest."""
    spark = labelled.sparkSession
    schema = "antecedent array<string>, confidence double, support double, any_of array<array<string>>, anchors array<string>"
    rows = stored(labelled.where("bad IS NOT NULL").select(F.array_distinct("tokens").alias("tokens"), "bad", F.monotonically_increasing_id().alias("row")))
    kinds = {r["bad"]: r["n"] for r in rows.groupBy("bad").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(kinds) < 2:
        return spark.createDataFrame([], schema)
    classes = stored(twins(rows, support * sum(kinds.values())))
    reps = classes.select("rep")
    reps = F.broadcast(reps) if classes.count() <= max_broadcast else reps
    # of tokens that always stand together one is mined, else their subsets alone would be 2^n item sets
    short = rows.select("row", "bad", F.explode_outer("tokens").alias("token")).join(reps, F.col("token") == F.col("rep"), "left").groupBy("row", "bad").agg(F.collect_list("rep").alias("tokens"))
    baskets = short.select(F.concat("tokens", F.array(F.when(F.col("bad"), "=bad").otherwise("=good"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == "=bad") & ~F.array_contains("antecedent", "=good"))
    rules = stored(rules.select(F.sort_array("antecedent").alias("antecedent"), "confidence", "support"))
    each = rules.select("antecedent", "confidence", F.explode_outer("antecedent").alias("t"))
    other = rules.select(F.col("antecedent").alias("a"), F.col("confidence").alias("c"))
    shorter = other.withColumn("t", F.element_at("a", 1))
    within = each.join(shorter, "t").where((F.size("a") < F.size("antecedent")) & (F.size(F.array_except("a", "antecedent")) == 0) & (F.col("c") >= F.col("confidence")))
    rules = rules.join(within.select("antecedent").distinct(), "antecedent", "left_anti")
    # filed under the rarest token
    places = rules.select("antecedent", F.explode_outer("antecedent").alias("rep")).join(classes, "rep")
    placed = places.groupBy("antecedent").agg(F.min(F.struct("n", "rep", "any_of")).alias("least"), F.sort_array(F.collect_list("any_of")).alias("any_of"))
    return rules.join(placed, "antecedent").select("antecedent", "confidence", "support", "any_of", F.col("least.any_of").alias("anchors"))


def blocked(urls: DataFrame, rules: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """The distinct ``url`` of ``urls`` (url, tokens) that a rule matches, with the most confident rule."""
    index = rules.select("antecedent", "confidence", "support", "any_of", F.explode("anchors").alias("anchor"))
    if index.count() <= max_broadcast:
        index = F.broadcast(index)
    posted = urls.select("url", "tokens", F.explode_outer("tokens").alias("token"))
    hits = posted.join(index, F.col("token") == F.col("anchor")).where(F.forall("any_of", lambda some: F.arrays_overlap(some, F.col("tokens"))))
    return hits.groupBy("url").agg(F.max(F.struct("confidence", "support", "antecedent")).alias("best")).select("url", F.col("best.antecedent").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = 0.001, confidence: float = 0.8) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, mined_rule, confidence.  ``labels`` (doc_id, quality) marks the
    page of the same number as bad where quality is 0."""
    pages = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("tokens"))
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    known = pages.join(marks, F.col("page_id") == F.col("doc_id")).select("tokens", "bad")
    learnt = stored(mined(known, support, confidence))
    hits = blocked(pages.where("url IS NOT NULL").select("url", "tokens"), learnt)
    rule, verdict = given(F.col("host"), F.col("path"), rules)
    out = pages.join(hits.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left").withColumn("rule", rule)
    method = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, method).alias("verdict"), "mined_rule", "confidence")
