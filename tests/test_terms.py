"""Many watch terms by one automaton: the counts of the regular expressions."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codesim.functions import text as T
from codesim.operators import report, terms
from codesim.params import Params

TERMS = ("the", "The", "a", "aa", "a a", "über", "naïve", "x1", "_y", "error code", "Straße", "ſo", "é", "kelvin", "日本", "a.b", "c++x")
PIECES = ["the", "THE", "a", "aa", " ", "  ", "_", ".", "über", "ÜBER", "naïve", "x1", "_y", "error code", "\n", "straße", "STRASSE", "ſo", "so", "SO", "É", "\u212aelvin", "日本", "語", "a.b", "c++x", "9", "İ", "ǅ", "\u0301", "٣"]


def test_counts_equal_the_expressions(spark):
    rng = random.Random(1)
    texts = ["", None, "a a a a", "aaa", "the the_the 1the the"] + ["".join(rng.choices(PIECES, k=rng.randint(1, 60))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    low = F.lower("content")
    one = rows.select("i", terms.term_counts(F.col("content"), TERMS).alias("n"), *[T.term_count(low, t).alias(f"t{k}") for k, t in enumerate(TERMS)])
    for r in one.collect():
        if texts[r.i] is None:
            assert r.n is None
        else:
            assert list(r.n) == [r[f"t{k}"] for k in range(len(TERMS))], texts[r.i]


@given(st.text(st.sampled_from("aAéß_ .1"), max_size=30))
@settings(max_examples=200, deadline=None)
def test_a_term_never_overlaps_itself(text):
    low = text.lower()
    n = terms.TermCounter(("a a",)).counts(low)[0]
    import re

    assert n == len(re.findall(r"(?<!\w)a a(?!\w)", low))


def test_both_ways_in_the_report(spark):
    many = tuple(f"t{i}" for i in range(terms.MANY)) + ("the",)
    files = spark.createDataFrame([(1, "t1 t2 t1 the", True), (2, "T15 the_", True), (3, "t1", False), (4, "", True)], "submission_id long, content string, used boolean")
    subs = files.select("submission_id")
    got = {}
    for some in (many, many[:3]):
        params = Params(terms=some)
        counted = report.with_term_counts(files, params, F.col("used")).where("used")
        got[some] = {(r.submission_id, r.term): r.n for r in report.term_counts(counted, subs, params).collect()}
        assert len(got[some]) == 4 * len(some)
    assert {k: v for k, v in got[many].items() if v} == {(1, "t1"): 2, (1, "t2"): 1, (1, "the"): 1, (2, "t15"): 1}
    assert all(got[many][k] == v for k, v in got[many[:3]].items())


def test_a_thousand_terms_cost_little_more_than_ten():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(5000)]
    text = " ".join(rng.choices(words, k=60_000))

    def seconds(n):
        counter = terms.TermCounter(tuple(dict.fromkeys(words))[:n])
        best = 9.0
        for _ in range(3):
            start = time.process_time()
            counter.counts(text)
            best = min(best, time.process_time() - start)
        return best

    assert seconds(1000) < 8 * seconds(10)  # a hundred times the terms; what grows is the matches
