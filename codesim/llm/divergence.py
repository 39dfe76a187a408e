"""Source divergence audit: how far the word use of each (lang, source) group is from the other sources of its
language and from the language as a whole, ranked by count cells.

Terms are the matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; a language keeps the terms found in
at least ``min_docs`` of its documents (V of them).  A group, or a language, gives every kept term
p = 1 + floor(1000000000 * (count + 1) / (N + V)), N being its number of kept occurrences, and two of these
differ in a term by f = floor((p - q) * (p - q) / q).  All of it is integer arithmetic.

f depends on counts alone, so it is worked out for cells of terms with equal counts:

* part ``term`` (p the group's, q its language's): terms are grouped by (group count, language count), f is
  evaluated once a cell, cells of equal f are merged, and merged values are ranked by cumulative multiplicity. Only the
  cells that reach the first ``limit`` ranks are expanded into their terms, in UTF-8 order.
* part ``pair`` (p the group's, q another source's): kept terms are first grouped by their whole row of counts over the
  sources, and f is evaluated once for each such row and pair of sources, in blocks of rows.

Documents are read once; a task sums its counts before they are shuffled by (lang, term), so that of a hot word or source a
task's sums travel, not its occurrences.  Per term only one number a source is gathered.  The table of groups is
sent to the tasks while it has at most ``max_broadcast`` rows, like the chosen cells; beyond that, joins give the same values.

Defined results: null text, lang and source are ''; a group without kept terms has rows in part ``pair`` (all its terms
have count 0) and none in ``term``; a language with V = 0 has 0 for every pair; a language with one source has no
pairs; repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes to term bytes: A-Z lowered, other term bytes kept, all else a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: A task sends on its sums when it holds this many terms.
HELD = 500_000
#: What a document adds to a sum beside its occurrences.
DOCUMENT = 1 << 40


def group_counts(docs: DataFrame) -> DataFrame:
    """lang, term, source, c (occurrences), d (documents): one row per term of a group, all rows of a term in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (lang, source), term to documents << 40 | occurrences
        sums: dict[tuple[str, str], dict[bytes, int]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in sums.items():
                n = len(terms)
                both = np.fromiter(terms.values(), np.int64, n)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, n), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.repeat(source, n), pa.array(both & (DOCUMENT - 1)), pa.array(both >> 40)], ["lang", "term", "source", "c", "d"])
            sums.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                seen: dict[bytes, int] = {}
                for term in text.as_py().translate(TERM_BYTES).split():
                    seen[term] = seen.get(term, DOCUMENT) + 1
                to = sums.setdefault((lang, source), {})
                held -= len(to)
                for term, c in seen.items():
                    to[term] = to.get(term, 0) + c
                held += len(to)
                if held > HELD:
                    yield from out()
                    held = 0
        yield from out()

    texts = docs.select(*(F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("lang", "source", "text")))
    # dealt by term before the sums of the tasks are added, so that both sums here need no other shuffle
    rows = texts.mapInArrow(run, "lang string, term string, source string, c long, d long").repartition("lang", "term")
    return rows.groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def kept_terms(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """lang, term, lc (count in the language), by (array of (source, c), sorted by source): the kept terms."""
    per = group_counts(docs).groupBy("lang", "term")
    rows = per.agg(F.sum("d").alias("df"), F.sum("c").alias("lc"), F.sort_array(F.collect_list(F.struct("source", "c"))).alias("by"))
    return rows.where(F.col("df") >= min_docs).drop("df")


def _p(count, total, kept) -> F.Column:
    """1 + floor(10^9 (count + 1) / (total + kept)); decimals where a long can't hold the product."""
    c, n = F.expr(f"({count}) + 1"), F.expr(f"({total}) + ({kept})")
    wide = F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * c.cast("decimal(20,0)"), n.cast("decimal(20,0)"))
    return F.when(c < 9_000_000_000, F.call_function("div", F.lit(1_000_000_000).cast("long") * c, n)).otherwise(wide) + 1


def _f(p, q) -> F.Column:
    p, q = F.col(p), F.col(q)
    return F.call_function("div", (p - q) * (p - q), q)


def groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, n (kept occurrences), v, nl (the language's V and N): every group that occurs."""
    every = docs.select(*(F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("lang", "source"))).distinct()
    own = terms.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.c").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lc").alias("nl"))
    return every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "nl"])


def _sized(df: DataFrame, max_broadcast: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= max_broadcast else df


def _shares(c: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (c + 1) / total), exact: whole numbers without bound where 64 bits can't hold the product."""
    if c.size and int(c.max()) >= 9_000_000_000:
        return (1 + 10**9 * (c.astype(object) + 1) // total.astype(object)).astype(np.int64)
    return 1 + 10**9 * (c + 1) // total


def _sums(langs: dict[str, tuple[list[str], np.ndarray, int]]):
    """Task part of ``pair_values``: (lang, by, m) to (lang, source, item, value), f summed over the task's rows.  A sum of f over any terms
    is under (sum of p + sum of q)^2, which 64 bits hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in batches:
            lang_of, by = b.column(0).dictionary_encode(), b.column(1)
            numbers = lang_of.indices.to_numpy()
            row = np.repeat(np.arange(len(by)), np.diff(by.offsets.to_numpy()))
            source_of, count = by.flatten().field("source").dictionary_encode(), by.flatten().field("c").to_numpy()
            m = b.column(2).to_numpy()
            for k, lang in enumerate(lang_of.dictionary.to_pylist()):
                sources, n, v = langs[lang]
                place = {s: i for i, s in enumerate(sources)}
                at = np.array([place.get(s, -1) for s in source_of.dictionary.to_pylist()], np.int64)
                mine = numbers == k
                here = mine[row]
                c = np.zeros((int(mine.sum()), len(sources)), np.int64)
                c[(np.cumsum(mine) - 1)[row[here]], at[source_of.indices.to_numpy()[here]]] = count[here]
                p = _shares(c, (n + v)[None, :])
                to = sums.setdefault(lang, np.zeros((len(sources), len(sources)), np.int64))
                for s in range(len(sources)):
                    d = p[:, s, None] - p
                    to[s] += m[mine] @ (d * d // p)
        for lang, to in sums.items():
            sources = langs[lang][0]
            i, j = np.nonzero(to)
            names = ([lang] * len(i), [sources[x] for x in i], [sources[x] for x in j])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in names), pa.array(to[i, j])], ["lang", "source", "item", "value"])

    return run


def pair_values(terms: DataFrame, at: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """lang, source, item (another source), value: f summed over all kept terms.  ``at`` is the table of ``groups``; up to
    ``max_broadcast`` groups, their totals go to the tasks, which sum rows of counts block by block."""
    if at.count() > max_broadcast:
        return pair_values_joined(terms, at)
    langs = {}
    for r in at.orderBy("lang", "source").toLocalIterator():  # at most ``max_broadcast`` rows
        sources, n, _ = langs.setdefault(r["lang"], ([], [], r["v"]))
        sources.append(r["source"])
        n.append(r["n"])
    langs = {lang: (sources, np.array(n, np.int64), v) for lang, (sources, n, v) in langs.items()}
    rows = terms.groupBy("lang", "by").agg(F.count("*").alias("m")).select("lang", "by", "m")
    sums = rows.mapInArrow(_sums(langs), "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    every = at.select("lang", "source").join(at.select("lang", F.col("source").alias("item")), "lang").where("source <> item")  # the result's rows
    return every.join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"])


def pair_values_joined(terms: DataFrame, at: DataFrame) -> DataFrame:
    """``pair_values`` for more groups than are sent to the tasks: joins only.  Absent terms are never written out: the sum is
    V f(0,0), plus a correction for each count of either source, plus one for each row of counts that holds both."""
    ours = at.select("lang", F.col("source").alias("s"), F.col("n").alias("ns"), "v")
    theirs = at.select("lang", F.col("source").alias("t"), F.col("n").alias("nt"))
    both = ours.join(theirs, "lang").where("s <> t")  # the result's rows

    def f(a: str, b: str) -> F.Column:
        p, q = _p(a, "ns", "v"), _p(b, "nt", "v")
        return F.call_function("div", (p - q) * (p - q), q).cast("decimal(38,0)")

    kept = F.col("v") > 0  # nothing is divided where no term is kept
    zero = both.select("lang", "s", "t", F.when(kept, F.col("v") * f("0", "0")).otherwise(0).cast("decimal(38,0)").alias("x"))
    counts = terms.select("lang", F.explode("by").alias("y")).groupBy("lang", F.col("y.source").alias("g"), F.col("y.c").alias("k")).agg(F.count("*").alias("m"))
    counts = stored(counts)
    mine = counts.withColumnRenamed("g", "s").join(ours, ["lang", "s"]).join(theirs, "lang").where("s <> t").select("lang", "s", "t", (F.col("m") * (f("k", "0") - f("0", "0"))).cast("decimal(38,0)").alias("x"))
    other = counts.withColumnRenamed("g", "t").join(theirs, ["lang", "t"]).join(ours, "lang").where("s <> t").select("lang", "s", "t", (F.col("m") * (f("0", "k") - f("0", "0"))).cast("decimal(38,0)").alias("x"))
    rows = terms.where(F.size("by") > 1).groupBy("lang", "by").agg(F.count("*").alias("m"))
    first = rows.select("lang", "m", "by", F.posexplode("by").alias("i", "y"))
    pairs = first.select("lang", "m", F.col("y").alias("y"), F.explode(F.slice("by", F.col("i") + 2, F.size("by"))).alias("z"))
    turned = pairs.select("lang", "m", F.explode(F.array(F.struct(F.col("y").alias("y"), F.col("z").alias("z")), F.struct(F.col("z").alias("y"), F.col("y").alias("z")))).alias("e"))
    joint = turned.select("lang", "m", F.col("e.y.source").alias("s"), F.col("e.y.c").alias("a"), F.col("e.z.source").alias("t"), F.col("e.z.c").alias("b")).join(ours, ["lang", "s"]).join(theirs, ["lang", "t"])
    joint = joint.select("lang", "s", "t", (F.col("m") * (f("a", "b") - f("a", "0") - f("0", "b") + f("0", "0"))).cast("decimal(38,0)").alias("x"))
    total = zero.union(mine).union(other).union(joint).groupBy("lang", "s", "t").agg(F.sum("x").cast("long").alias("value"))
    return total.select("lang", F.col("s").alias("source"), F.col("t").alias("item"), "value")


def term_ranks(terms: DataFrame, at: DataFrame, limit: int = 200, max_broadcast: int = 100_000) -> DataFrame:
    """lang, source, item (a term the group uses more than its language), value, rank up to ``limit``."""
    uses = terms.select("lang", "term", "lc", F.explode("by").alias("x")).select("lang", F.col("x.source").alias("source"), F.col("x.c").alias("c"), "lc", "term")
    cells = uses.groupBy("lang", "source", "c", "lc").agg(F.count("*").alias("m")).join(at, ["lang", "source"])
    cells = cells.select("lang", "source", "c", "lc", "m", _p("c", "n", "v").alias("p"), _p("lc", "nl", "v").alias("q")).where("p > q").withColumn("value", _f("p", "q"))
    cells = stored(cells.select("lang", "source", "c", "lc", "m", "value"))
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    # each value stands for a term at least, so the first ``limit`` values hold the first ``limit`` ranks
    values = merged.withColumn("i", F.row_number().over(down)).where(F.col("i") <= limit)
    values = values.withColumn("before", F.sum("m").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).where(F.col("before") < limit)
    chosen = stored(cells.join(values.select("lang", "source", "value", "before"), ["lang", "source", "value"]).select("lang", "source", "c", "lc", "value", "before"))
    members = uses.join(_sized(chosen, max_broadcast), ["lang", "source", "c", "lc"])
    members = members.withColumn("i", F.row_number().over(Window.partitionBy("lang", "source", "value").orderBy("term"))).where(F.col("i") <= limit)
    return members.withColumn("rank", (F.col("before") + F.col("i")).cast("int")).where(F.col("rank") <= limit).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def audit(docs: DataFrame, min_docs: int = 3, limit: int = 200, max_broadcast: int = 100_000) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: all other sources of the language by their divergence,
    and the first ``limit`` terms that set the group apart from its language."""
    terms = stored(kept_terms(docs, min_docs))
    at = stored(groups(docs, terms))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(terms, at, max_broadcast).withColumn("rank", F.row_number().over(order))
    names = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*names).union(term_ranks(terms, _sized(at, max_broadcast), limit, max_broadcast).withColumn("part", F.lit("term")).select(*names))
