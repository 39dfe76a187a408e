"""Result tables survive a parquet round trip; list parameters parse like
the form fields they replace."""

import pytest

from codesim import analyze
from codesim.params import parse_list
from codesim.sources import fixture
from codesim.sources.sinks import read_tables, versions, write_tables

from .conftest import SF001


def _shown(df):
    """Rows as text; sums of doubles may differ in their last digits between two runs."""
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_parquet_round_trip(spark, tmp_path):
    a = analyze(fixture.submission_files(spark, SF001), fixture.template_files(spark, SF001), overall_thresh=0.05)
    paths = write_tables(a, str(tmp_path))
    assert set(paths) == {"submissions", "term_counts", "pairs", "flagged_files", "line_overlap", "summary",
                          "pair_report"}
    back = spark.read.parquet(paths["pairs"])
    assert sorted(back.collect()) == sorted(a.pairs.collect())
    rep = spark.read.parquet(paths["pair_report"]).collect()
    for name, df in a.tables().items():
        assert _shown(spark.read.parquet(paths[name])) == _shown(df), name
    n_flagged = sum(len(r["flagged_files"]) for r in rep)
    assert n_flagged == a.flagged_files.count() and len(rep) == back.count()


def test_a_failed_run_leaves_the_version_before(spark, tmp_path):
    class Run:
        """Stands for an analysis; the last table fails while it is written."""

        def __init__(self, n, fails=False):
            self.spark = spark
            self.pairs = spark.createDataFrame([(1, 2, 0.5 + n)], "id_a long, id_b long, overall double")
            self.flagged_files = spark.createDataFrame([(1, 2, 1, "a", "b", "cross", 0.9, "high")], "id_a long, id_b long, rank int, path_a string, path_b string, kind string, similarity double, severity string")
            self.last = spark.range(n + 1).selectExpr("raise_error('lost') AS x" if fails else "id AS x")

        def tables(self):
            return {"pairs": self.pairs, "last": self.last}

    out = str(tmp_path / "results")
    write_tables(Run(0), out)
    first = versions(spark, out)
    with pytest.raises(Exception, match="lost"):
        write_tables(Run(1, fails=True), out)
    assert len(list((tmp_path / "results" / "versions").iterdir())) == 2  # half a version is there
    assert versions(spark, out) == first
    old = read_tables(spark, out)
    assert set(old) == {"pairs", "last", "pair_report"} and old["pairs"].first().overall == 0.5
    write_tables(Run(2), out)
    assert old["last"].count() == 1  # readers of the old version go on
    assert read_tables(spark, out)["pairs"].first().overall == 2.5 and read_tables(spark, out, first[0])["last"].count() == 1
    write_tables(Run(3), out, keep=1)
    assert read_tables(spark, out)["last"].count() == 4 and len(versions(spark, out)) == 3
    with pytest.raises(Exception):
        read_tables(spark, out, first[0])["last"].count()
    with pytest.raises(ValueError):
        read_tables(spark, out, "none")


def test_parse_list():
    assert parse_list(" any, todo ,,", trim=True) == ("any", "todo")
    assert parse_list("py, java", trim=False) == ("py", " java")
    assert parse_list("", trim=True) == ()
