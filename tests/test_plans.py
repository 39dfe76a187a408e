"""Plan-shape guards for the scale properties the design relies on, on plans that nothing was written for."""

import contextlib
import io
import re

import pytest

from codesim import analyze
from codesim.plans import catalogue
from codesim.sources import fixture

from .conftest import SF001


@pytest.fixture(scope="module")
def split_dir(spark, tmp_path_factory):
    """The documents as a scan of several partitions."""
    d = str(tmp_path_factory.mktemp("split"))
    spark.read.parquet(f"{SF001}/documents.parquet").repartition(6).write.parquet(f"{d}/documents.parquet")
    return d


def _explained(df, mode="formatted") -> str:
    df.collect()  # AQE: the executed plan is final after an action
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def _lazy(spark, d, **kw):
    return analyze(fixture.submission_files(spark, d), fixture.template_files(spark, d), persist=False, **kw)


def _exchanged(plan: str) -> list[str]:
    """The columns of every exchange."""
    return re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan, re.S)


def test_no_content_in_a_shuffle_and_no_cross_join(spark, split_dir):
    plan = _explained(_lazy(spark, split_dir, overall_thresh=0.05).counts)
    assert "regexp_replace" in plan     # the whole way is in sight
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan, bad
    exchanged = _exchanged(plan)
    assert len(exchanged) > 5
    assert not [c for c in exchanged if re.search(r"\b(content|norm|text|_tok)#", c)]


def test_group_limit_before_the_shuffle(spark):
    plan = _explained(catalogue._analysis(spark, SF001).pairs)
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_flagged_contents_stay_where_they_are_read(spark, split_dir):
    a = _lazy(spark, split_dir)
    wanted = spark.createDataFrame([(2, "src/f0.py"), (3, "src/f1.py")], "submission_id long, path string")
    plan = _explained(a.files_of(wanted, a.contents, "content"))
    assert not [c for c in _exchanged(plan) if re.search(r"\b(content|norm|text)#", c)]


def test_single_purpose_queries_do_not_shingle(spark, split_dir):
    for q in (catalogue.norm_hash, catalogue.template_subtracted, catalogue.submission_overview):
        assert "regexp_extract_all" not in _explained(q(spark, split_dir))


def test_documents_scan_is_pruned(spark):
    plan = catalogue.files_admitted(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan   # no text, no n_chars


def test_pair_positions_need_no_single_task(spark):
    rows = [(i, i + j, (i * 7 + j * 3) % 10 / 10) for i in range(40) for j in range(1, 6)]
    pairs = spark.createDataFrame(rows, "id_a long, id_b long, overall double").repartition(8)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = catalogue.positions(pairs)
        plan = _explained(out, "simple")
        got = {(r.id_a, r.id_b): r.position for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    want = {(a, b): n for n, (a, b, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0], r[1])), 1)}
    assert got == want
    # only the partitions' sizes meet in one task
    assert not re.search(r"windowspecdefinition\(overall", plan)
