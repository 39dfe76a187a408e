"""Quality rules: robust multivariate outliers per language and source.

Base counts (words, symbols, repeated lines, words in repeated windows) come from one pass over
the whole texts.  Documents that pass the base limits get a vector of ``P`` transformed statistics, and a
minimum-covariance-determinant estimate per (lang, source) tells how far a document lies from the
bulk of its group: a robust squared Mahalanobis distance over ``cutoff`` rejects it.

The estimate works on sums only, so a group of any size is spread over all tasks: start at
the medians and quartile ranges; each concentration step bins the group's squared
distances (24 bins for each doubling), adds count, sums and cross products by bin, keeps the nearest bins that hold at
least ``share`` of the vectors and takes their mean and covariance, which never raises the determinant
beyond the bins' width.  After ``steps`` steps comes the usual consistency factor and one reweighting step over the vectors
inside the 97.5 % ellipsoid.  Equal vectors count once, so that copies can't become the bulk; every
statistic has a least spread (``FLOORS``), so that a group of near-equal documents doesn't reject
everything else.  Groups of fewer than ``least`` vectors are pooled by language, then over the corpus;
a pool that is still smaller rejects nothing.

Defined results: null text has no words and fails the base limits; null lang or source are values
like any other; repeated rows get equal answers; an empty table gives an empty result;
other columns are ignored (``keep`` passes them on).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_key, unused

#: Statistics: log of letters a word, then arcsine roots of the shares of symbols, capitals, marks (!?|)
#: and digits among word characters, of repeated lines, of words in repeated windows and of words equal to the
#: one before.
P = 8
#: The least standard deviation of each: what clean prose may differ by from its own group.  A share alone can pass the default cutoff,
#: 42.7, in a group without spread: (pi / 2 / floor)^2 is over it for all but repeated words, which have the base limit.
FLOORS = (0.15, 0.06, 0.07, 0.05, 0.12, 0.22, 0.25, 0.1)
FEATURES = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
CAPITALS = bytes(range(65, 91))
CAPITALS_LATIN = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")


def repeated_window_words(words: list[bytes], size: int = 8) -> int:
    """Words inside windows of ``size`` words that occur twice or more, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[j:j + n]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))  # equal hashes are checked word by word
    seen: dict[bytes, list[int]] = {}
    for i in at.tolist():
        seen.setdefault(ids[i:i + size].tobytes(), []).append(i)
    edges = np.zeros(len(words) + 1, np.int64)
    for starts in seen.values():
        if len(starts) > 1:
            np.add.at(edges, starts, 1)
            np.add.at(edges, np.array(starts) + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def _chars(b: bytes) -> int:
    return len(b) if b.isascii() else len(b.decode("utf-8", "replace"))


def statistics(text: bytes) -> list[float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the vector."""
    words = text.split()  # bytes: splits at \x20 and \x09-\x0D only
    n, chars = len(words), _chars(b"".join(words))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dups = len(lines) - len(set(lines))
    repeats = repeated_window_words(words)
    capitals = len(text) - len(text.translate(None, CAPITALS)) + len(CAPITALS_LATIN.findall(text))
    marks = len(text) - len(text.translate(None, b"!?|"))
    digits = len(text) - len(text.translate(None, b"0123456789"))
    share = lambda k, m: math.asin(math.sqrt(min(1.0, k / (m + 1.0))))
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    vector = [math.log((chars + 5) / (n + 1)), share(symbols, chars), share(capitals, chars), share(marks, chars), share(digits, chars), share(dups, len(lines)), share(repeats, n), share(stutter, n)]
    return [n, chars, symbols, dups, repeats, *vector]


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, key, lang, source, the base counts and the vector, a row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t or b"") for t in b.column(4).cast(pa.binary()).to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * (len(COUNTS) + P)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.float64()) for c in cols[5:])], ["doc_id", "key", "lang", "source", *COUNTS, *FEATURES])

    schema = "doc_id long, key long, lang string, source string, " + ", ".join([*(f"{c} long" for c in COUNTS), *(f"{x} double" for x in FEATURES)])
    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(run, schema)


def base_failed(least_words: int = 20, repeat_pct: int = 30) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words"))


def chi2_cdf(x: float, k: int) -> float:
    """Distribution of chi-squared with k degrees of freedom, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    i = a
    while term > 1e-17 * total:
        i += 1
        term *= h / i
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 10.0 * k + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of a normal sample must be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def _estimate(share: float, factor: float):
    """Of one gid's sums by bin, at most ``BINS`` rows: (gid, mu, prec), the mean and the inverse covariance, never under the floors, of
    the nearest bins that hold at least ``share`` of the vectors."""

    def run(key, bins):
        bins = bins.sort_values("bin")
        n = bins["n"].to_numpy()
        near = bins[np.cumsum(n) - n < share * n.sum()].drop(columns=["gid", "bin"]).sum()
        mu = np.array([near[f"s{i}"] for i in range(P)]) / near["n"]
        cov = np.zeros((P, P))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = (near[f"c{i}_{j}"] / near["n"] - mu[i] * mu[j]) * factor
        value, vector = np.linalg.eigh(cov / np.outer(FLOORS, FLOORS))
        inverse = (vector / np.maximum(value, 1.0)) @ vector.T / np.outer(FLOORS, FLOORS)
        return type(bins)([(key[0], mu.tolist(), inverse.ravel().tolist())], columns=["gid", "mu", "prec"])

    return run


def distance(mu: str = "mu", prec: str = "prec") -> Column:
    z = [F.col(x) - F.element_at(mu, i + 1) for i, x in enumerate(FEATURES)]
    d = F.lit(0.0)
    for i, j in PAIRS:
        d = d + z[i] * z[j] * F.element_at(prec, P * i + j + 1) * (1 if i == j else 2)
    return d


AT = "gid string, mu array<double>, prec array<double>"
#: Distances are told apart by at most so many bins.
BINS = 501


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i, j in PAIRS)]


def _fit(vectors: DataFrame, at: DataFrame, bin: Column, share: float, factor: float) -> DataFrame:
    """New (gid, mu, prec), stored: of each group's vectors, put into bins by their distance from ``at``, the nearest.  ``at`` has a row per
    group, so that no vector is shuffled; sums are."""
    placed = vectors.join(at, "gid").select("gid", bin.cast("int").alias("bin"), *FEATURES).where("bin IS NOT NULL")
    return stored(placed.groupBy("gid", "bin").agg(*_sums()).groupBy("gid").applyInPandas(_estimate(share, factor), AT))


def mcd(vectors: DataFrame, share: float = 0.75, steps: int = 4, max_broadcast: int = 20_000) -> DataFrame:
    """(gid, mu, prec) for every gid of ``vectors`` (gid, x0..): the reweighted MCD estimate.  Each step's estimates are
    stored and, up to ``max_broadcast`` groups, broadcast to the vectors; beyond that the join is a shuffle with AQE's skew split."""
    quarts = vectors.groupBy("gid").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, x in enumerate(FEATURES)))
    spread = [F.greatest(F.lit(FLOORS[i]), (F.element_at(f"q{i}", 3) - F.element_at(f"q{i}", 1)) / 1.349) for i in range(P)]
    prec = F.array(*(1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)))
    at = stored(quarts.select("gid", F.array(*(F.element_at(f"q{i}", 2) for i in range(P))).alias("mu"), prec.alias("prec")))
    few = at.count() <= max_broadcast
    here = F.broadcast if few else lambda df: df
    nearness = F.least(F.floor(24 * F.log2(1 + F.greatest(F.lit(0.0), distance()))), F.lit(BINS - 1))
    for _ in range(steps):
        at = _fit(vectors, here(at), nearness, share, consistency(share))
    return _fit(vectors, here(at), F.when(distance() <= chi2_quantile(0.975, P), 0), 1.0, consistency(0.975))


def group_ids(vectors: DataFrame, least: int) -> DataFrame:
    """(lang, source, gid) for each pair of them in ``vectors``; gid is null where even the pool of the rest is too small."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    pairs = vectors.groupBy("lang", "source").agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("gid", F.when(F.col("n") >= least, F.to_json(F.array(named("lang"), named("source")))))
    by_lang = pairs.where("gid IS NULL").groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("m"))
    by_lang = by_lang.withColumn("lang_gid", F.when(F.col("m") >= least, F.to_json(F.array(F.coalesce(F.concat(F.lit("="), "l"), F.lit("-"))))))
    rest = by_lang.where("lang_gid IS NULL").agg(F.sum("m").alias("r")).select((F.col("r") >= least).alias("enough"))
    pairs = pairs.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("gid", F.coalesce("gid", "lang_gid", F.lit("rest"))).select("lang", "source", "gid")
    small = pairs.where("gid = 'rest'").join(F.broadcast(rest), F.lit(True), "left").select("lang", "source", F.when(F.col("enough"), F.col("gid")).alias("gid"))  # ``rest`` is one row
    return pairs.where("gid <> 'rest'").unionByName(small)


def verdicts(docs: DataFrame, share: float = 0.75, steps: int = 4, least: int = 100, cutoff: float | None = None, least_words: int = 20, repeat_pct: int = 30, max_broadcast: int = 20_000) -> DataFrame:
    """Per row of ``docs``: doc_id, key, the base counts, base_failed, distance (null where no estimate applies)
    and kept.  ``cutoff`` is the largest squared distance kept (None: the point that a normal vector passes once in 10^6)."""
    cutoff = chi2_quantile(1 - 1e-6, P) if cutoff is None else cutoff
    rows = stored(measured(docs).withColumn("base_failed", base_failed(least_words, repeat_pct)))
    vectors = rows.where("NOT base_failed").select("lang", "source", *FEATURES).distinct()
    groups = stored(group_ids(vectors, least))
    few = groups.count() <= max_broadcast
    here = F.broadcast if few else lambda df: df
    same = lambda a, b: a["lang"].eqNullSafe(b["lang"]) & a["source"].eqNullSafe(b["source"])
    grouped = stored(vectors.join(here(groups), same(vectors, groups)).where("gid IS NOT NULL").select("gid", *FEATURES))
    fits = stored(groups.join(here(mcd(grouped, share, steps, max_broadcast)), "gid").select("lang", "source", "mu", "prec"))
    judged = rows.join(here(fits), same(rows, fits), "left")
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), distance()))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).select("doc_id", "key", *COUNTS, "base_failed", "distance", "kept")


def keep(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` without the rejected rows; all columns stay."""
    of, key = unused(docs, "of", "key")
    good = verdicts(docs, **limits).where("kept").select(F.col("doc_id").alias(of), F.col("key").alias(key)).distinct()
    return docs.join(good, docs["doc_id"].cast("long").eqNullSafe(F.col(of)) & (text_key(docs["text"]) == F.col(key)), "left_semi")
