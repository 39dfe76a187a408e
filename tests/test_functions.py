"""Hand-computed cases for the per-file rules (FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from codesim.functions import text as T
from codesim.operators import corpus, report
from codesim.params import Params, normalise_terms


def one(spark, expr, *vals, schema="a string"):
    df = spark.createDataFrame([tuple(vals)], schema)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("src,ext,want", [
    ('x = "a # b" # c', "py", 'x = ""'),
    ('"""a\nb"""\ny', "py", '"" y'),
    ("# don't\nx='k'", "py", ""),
    ("a/**/b", "java", "ab"),
    ('s = "http://x"; t', "java", 's = "http:'),
    ('s = "a\\"b";', "java", 's = "";'),
    ("select 1 -- note", "sql", "select 1 -- note"),
    ("char c = 'x'; // z\n  A  B  ", "c", "char c = ''; a b"),
    ("A\x1cB\x0bC", "js", "a b c"),
])
def test_normalize(spark, src, ext, want):
    assert one(spark, T.normalize(F.col("c"), F.col("e")), src, ext, schema="c string, e string") == want


def test_possessive_string_pattern_survives_many_escapes(spark):
    src = '"' + "\\x" * 200000 + '"'
    assert one(spark, T.normalize(F.col("c"), F.lit("java")), src, schema="c string") == '""'


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("a")), "foo_1 + Été") == ["foo_1", "t"]


@pytest.mark.parametrize("text,k,n", [("", 5, 0), ("a b c", 5, 1), ("a b c d e f", 5, 2),
                                      ("a a a a a a a", 5, 1), ("a b c d e", 5, 1), ("a b a b", 1, 2)])
def test_shingle_counts(spark, text, k, n):
    assert one(spark, F.size(T.shingle_texts(T.tokens(F.col("a")), k)), text) == n


def test_shingle_texts(spark):
    got = one(spark, T.shingle_texts(T.tokens(F.col("a")), 3), "a b c d")
    assert sorted(got) == ["a b c", "b c d"]


@pytest.mark.parametrize("i,na,nb,want", [(0, 0, 0, 1.0), (0, 3, 0, 0.0), (2, 4, 4, 2 / 6), (3, 3, 3, 1.0)])
def test_jaccard(spark, i, na, nb, want):
    got = one(spark, T.jaccard(F.col("i"), F.col("a"), F.col("b")), i, na, nb, schema="i long, a long, b long")
    assert got == pytest.approx(want)


@pytest.mark.parametrize("path,ext", [("A.PY", "py"), ("Makefile", "makefile"), ("py", "py"), ("a/py", "a/py"),
                                      ("x.tar.SQL", "sql")])
def test_extension(spark, path, ext):
    assert one(spark, T.extension(F.col("a")), path) == ext


@pytest.mark.parametrize("path,skip", [("x/Build/a.py", True), ("x/out", True), ("x/src/a.py", False),
                                       ("node_modules", True), ("a/outer/b.py", False)])
def test_excluded(spark, path, skip):
    assert one(spark, T.excluded(F.col("a"), Params().exclude_dirs), path) is skip


def _strip(spark, paths, compat=False):
    df = spark.createDataFrame([(0, p) for p in paths], "submission_id long, raw_path string")
    return sorted(r["path"] for r in corpus.strip_common_prefix(df, compat).collect())


def test_strip_common_prefix(spark):
    assert _strip(spark, ["r/a.py", "r/b/c.py"]) == ["a.py", "b/c.py"]
    assert _strip(spark, ["r/a.py", "q/b.py"]) == ["q/b.py", "r/a.py"]
    assert _strip(spark, ["main.py"]) == ["main.py"]
    assert _strip(spark, ["main.py"], compat=True) == [""]


def test_split_lines(spark):
    cases = {"a\nb\n": ["a", "b"], "a\r\nb": ["a", "b"], "": [], "\n": [""], "a\x0bb c\r": ["a", "b", "c"],
             "x\n\ny": ["x", "", "y"]}
    for src, want in cases.items():
        assert one(spark, T.split_lines(F.col("a")), src) == want == src.splitlines()


def test_term_count_word_edges(spark):
    text = "étodo todo todoé x_todo TODO todo²"
    assert one(spark, T.term_count(F.lower(F.col("a")), "todo"), text) == 2


@pytest.mark.parametrize("sim,band", [(0.8, "critical"), (0.6, "high"), (0.4, "medium"), (0.39, "low")])
def test_severity(spark, sim, band):
    assert one(spark, T.severity(F.col("s")), sim, schema="s double") == band


def test_neumaier_matches_python_sum(spark):
    vals = [0.1, 0.2, 0.3, 1e-17, 0.7]
    got = one(spark, report.neumaier_sum(F.col("a")), vals, schema="a array<double>")
    assert got == sum(vals)


def _overall(spark, sims_by_pair, common):
    rows = [(a, b, "cross", s) for (a, b), ss in sims_by_pair.items() for s in ss]
    pos = spark.createDataFrame(rows, "id_a long, id_b long, kind string, similarity double")
    com = spark.createDataFrame([(a, b, n) for (a, b), n in common.items()], "id_a long, id_b long, n_common long")
    return {(r["id_a"], r["id_b"]): r["overall"] for r in report.overall_from_positive(pos, com, 5).collect()}


def test_overall_top5_mean(spark):
    got = _overall(spark, {(0, 1): [.9, .8, .7, .6, .5, .1], (0, 2): [.9]}, {(0, 2): 1})
    assert got[(0, 1)] == pytest.approx(0.7)
    # one positive cross sim and one zero same-path sim -> mean of (.9, 0)
    assert got[(0, 2)] == pytest.approx(0.45)


def test_terms_validation():
    assert normalise_terms([" any", "any", "", "todo "]) == ("any", "todo")
    with pytest.raises(ValueError):
        normalise_terms(["c++"])
    with pytest.raises(ValueError):
        Params(shingle_size=0)
