"""Benchmark decontamination: a hash set of the normalised test windows, scanned
over every training token window.  DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z-lower-cased text.  A benchmark item gives
its windows of ``window`` consecutive words; a shorter item that has words is one window.
Each document is read once: its windows are hashed in place, exploded as (position, hash) and
probed against the test windows by their hash; a hit counts only if the words themselves are
equal.  The test windows are broadcast while they take at most ``max_broadcast`` bytes; beyond that
the same join runs as a shuffle.  Only hits leave the scan, by the window's number, next to one row
per document that carries its word count; which items hold a window is looked up afterwards, once for each set of windows
that some document has, so a window that many items and many documents share is never multiplied out.

Defined results: null and empty texts have no words and are never hit; items without
words match nothing; items without an id hit like any other, are counted together as one of ``n_items`` and are left out of ``items``; a window shared by items counts for each; rows that repeat a doc_id
are told apart by their text, equal rows get equal answers; empty tables give empty results or
no hits; other columns are ignored (``remove_*`` pass them on).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, text_key, unused

#: Whatever stands between words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text) -> F.Column:
    """The words in order; an empty array for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def _hash(hashes: str, at, k: int) -> F.Column:
    """Hash of the ``k`` words from ``at`` on, given the words' own hashes.  Single elements are read, as
    ``slice`` copies the whole array each time."""
    return F.xxhash64(*(F.get(hashes, at + j) for j in range(k)))


def test_windows(benchmark: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """(wid, h, len, gram (array of words)), one row per distinct window, and (wid, item_id), the items that hold it; both stored."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    long = F.size("w") >= window
    starts = items.withColumn("at", F.explode_outer(F.when(long, F.sequence(F.lit(0), F.size("w") - window)).otherwise(F.array(F.lit(0)))))
    held = stored(starts.select("item_id", F.when(long, F.array(*(F.get("w", F.col("at") + j) for j in range(window)))).otherwise(F.col("w")).alias("gram")).distinct())
    grams = held.select("gram").distinct().withColumn("len", F.size("gram")).withColumn("g", F.transform("gram", lambda x: F.xxhash64(x)))
    h = F.coalesce(*(F.when(F.col("len") == k, _hash("g", F.lit(0), k)) for k in range(1, window + 1)))
    windows = stored(grams.select(F.monotonically_increasing_id().alias("wid"), h.alias("h"), "len", "gram"))
    return windows, stored(held.join(windows.select("wid", "gram"), "gram").select("wid", "item_id"))


def scan(docs: DataFrame, tests: DataFrame, window: int = 10, max_broadcast: int = 64 << 20) -> DataFrame:
    """Rows (doc_id, key, n_words, at, len, wid): for every row of ``docs`` one with at = -1, and one
    for each occurrence of a window of ``tests``, at its first word (from 0)."""
    size = F.aggregate("gram", F.lit(64).cast("long"), lambda s, x: s + 16 + F.octet_length(x))
    measured = tests.groupBy("len").agg(F.sum(size).alias("bytes")).collect()  # at most ``window`` rows
    sizes = {r["len"]: r["bytes"] for r in measured}
    docs = docs.select("doc_id", text_key(F.col("text")).alias("key"), words(F.col("text")).alias("w"))
    docs = docs.withColumn("n_words", F.size("w").cast("long"))
    # a window is coded as at * base + k; -1 stands for the document itself
    base = window + 1
    codes = [F.array(F.lit(-1).cast("long"))]
    codes += [F.when(F.size("w") >= k, F.sequence(F.lit(k).cast("long"), (F.size("w") - k).cast("long") * base + k, F.lit(base).cast("long"))).otherwise(F.array().cast("array<bigint>")) for k in sorted(sizes)]
    # explode_outer, though no array is empty: for explode Spark infers a filter that splits the text again for every window
    rows = docs.withColumn("hw", F.transform("w", lambda x: F.xxhash64(x))).select("doc_id", "key", "n_words", "w", "hw", F.explode_outer(F.concat(*codes)).alias("code"))
    rows = rows.withColumn("at", F.floor(F.col("code") / base).cast("int")).withColumn("k", F.pmod("code", F.lit(base)).cast("int"))
    th = F.coalesce(*(F.when((F.col("k") == k) & (F.col("code") >= 0), _hash("hw", F.col("at"), k)) for k in sorted(sizes)), F.lit(None).cast("long"))
    rows = rows.withColumn("th", th)
    if sum(sizes.values()) > max_broadcast:
        return _shuffled(docs, rows, tests)
    same = F.lit(True)
    for j in range(window):
        same = same & ((F.col("len") <= j) | (F.get("w", F.col("at") + j) == F.get("gram", F.lit(j))))
    on = (F.col("th") == F.col("h")) & (F.col("k") == F.col("len")) & same
    return rows.join(F.broadcast(tests), on, "left").where("code < 0 OR h IS NOT NULL").select("doc_id", "key", "n_words", "at", F.coalesce("len", F.lit(0)).alias("len"), "wid")


def _shuffled(docs: DataFrame, rows: DataFrame, tests: DataFrame) -> DataFrame:
    """The way for test sets beyond the broadcast bound: hash join by shuffle, then the few candidates meet
    their document's words again to be verified."""
    narrow = rows.where("code >= 0").select("doc_id", "key", "at", "k", "th")
    near = narrow.join(tests, (F.col("th") == F.col("h")) & (F.col("k") == F.col("len"))).select(F.col("doc_id").alias("d"), F.col("key").alias("dk"), "at", "len", "gram", "wid").distinct()
    pairs = docs.dropDuplicates(["doc_id", "key"]).join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("dk")))
    sure = pairs.where(F.forall(F.sequence(F.lit(0), F.col("len") - 1), lambda j: F.get("w", F.col("at") + j) == F.get("gram", j)))
    return sure.select("doc_id", "key", "n_words", "at", "len", "wid").unionByName(docs.select("doc_id", "key", "n_words", F.lit(-1).alias("at"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("wid")))


def hits(docs: DataFrame, tests: DataFrame, window: int = 10, max_broadcast: int = 64 << 20) -> DataFrame:
    """Per distinct (doc_id, text) of ``docs``: doc_id, key, n_words, rows, n_hit, spans (array of (at, len): the disjoint runs of hit words, in
    order), wids (sorted array of the windows that occur)."""
    found = scan(docs, tests, window, max_broadcast)
    hit = F.col("at") >= 0
    per = found.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(hit, 0).otherwise(1)).alias("rows"),
        F.sort_array(F.collect_set(F.when(hit, F.struct("at", "len")))).alias("hits"),
        F.sort_array(F.collect_set("wid")).alias("wids"),
    )
    # hits come sorted by position: a hit that touches the last run lengthens it
    spans = F.aggregate("hits", F.array().cast("array<struct<at:int,len:int>>"), lambda runs, x: F.when(
        (F.size(runs) > 0) & (F.element_at(runs, -1)["at"] + F.element_at(runs, -1)["len"] >= x["at"]),
        F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(F.element_at(runs, -1)["at"].alias("at"), (F.greatest(F.element_at(runs, -1)["at"] + F.element_at(runs, -1)["len"], x["at"] + x["len"]) - F.element_at(runs, -1)["at"]).alias("len")))),
    ).otherwise(F.concat(runs, F.array(F.struct(x["at"].alias("at"), x["len"].alias("len"))))))
    per = per.withColumn("spans", F.when(F.size("hits") > 0, spans).otherwise(F.array().cast("array<struct<at:int,len:int>>")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["len"])
    return per.withColumn("n_hit", n_hit).select("doc_id", "key", "n_words", "rows", "n_hit", "spans", "wids")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_broadcast: int = 64 << 20) -> DataFrame:
    """Per row of ``docs``: doc_id, key, n_words, n_hit, n_items, items (sorted array of item ids), spans (see ``hits``)."""
    tests, members = test_windows(benchmark, window)
    per = stored(hits(docs, tests, window, max_broadcast))
    # items are looked up once for each set of windows that occurs, however many documents have it
    sets = stored(per.where(F.size("wids") > 0).select("wids").distinct())
    few = members.agg(F.coalesce(F.sum(F.octet_length(F.col("item_id").cast("string")) + 24), F.lit(0))).first()[0] <= max_broadcast
    held = sets.select("wids", F.explode("wids").alias("wid")).join(F.broadcast(members) if few else members, "wid")
    items = held.groupBy("wids").agg(F.sort_array(F.flatten(F.collect_set(F.array("item_id")))).alias("items"))
    none = F.array().cast(f"array<{members.schema['item_id'].dataType.simpleString()}>")
    # documents without a hit, most of them, have no set to look up
    clean = per.where(F.size("wids") == 0).withColumn("items", none)
    rows = per.where(F.size("wids") > 0).join(items, "wids", "left").withColumn("items", F.coalesce("items", none)).unionByName(clean)
    # equal rows were counted together: give each its row again
    again = F.explode_outer(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return rows.select("doc_id", "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.array_compact("items").alias("items"), "spans", again.alias("nth")).drop("nth")


def _hit(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    return hits(docs, test_windows(benchmark, window)[0], window).where("n_hit > 0")


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a test window; all columns stay."""
    of, key = unused(docs, "of", "text_key")
    bad = _hit(docs, benchmark, window).select(F.col("doc_id").alias(of), F.col("key").alias(key))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(of)) & (text_key(docs["text"]) == F.col(key)), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with the hit words, and the gap after each, cut from ``text``; all else stays."""
    of, key, spans, parts, lead = unused(docs, "of", "text_key", "spans", "parts", "lead")
    bad = _hit(docs, benchmark, window).select(F.col("doc_id").alias(of), F.col("key").alias(key), F.col("spans").alias(spans))
    on = docs["doc_id"].eqNullSafe(F.col(of)) & (text_key(docs["text"]) == F.col(key))
    # (word, gap) in turn; a leading gap makes an empty first word
    split = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), F.lit(0))
    led = F.when(F.regexp_like(F.col("text"), F.lit(r"\A[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")), 1).otherwise(0)
    cut = F.array_join(F.filter(parts, lambda p, i: ~F.exists(spans, lambda s: (i - F.col(lead) >= s["at"]) & (i - F.col(lead) < s["at"] + s["len"]))), "")
    joined = docs.join(bad, on, "left").withColumn(parts, F.when(F.col(spans).isNotNull(), split)).withColumn(lead, led)
    return joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)
