"""Whole-analysis checks: the DuckDB statements at several thresholds, and small corpora with
hand-computed results."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from codesim import Params, analyze
from codesim.operators import similarity as S
from codesim.plans import oracle
from codesim.plans.catalogue import FIXTURE_TERMS
from codesim.sources import fixture

from .conftest import SF001

BODY = "\n".join(f"acc_{i} = fold(acc_{i - 1}, row_{i})" for i in range(1, 14)) + "\n"   # 52 distinct-shingle tokens: 48 shingles
OTHER = "\n".join(f"total_{i} += item_{i} * {i}" for i in range(12)) + "\n"
EMPTY = "# nothing\n" * 12


def _fixture(spark, **kw):
    return analyze(fixture.submission_files(spark, SF001), fixture.template_files(spark, SF001), terms=FIXTURE_TERMS, **kw)


def _files(spark, rows):
    return spark.createDataFrame(rows, "submission_id long, submission string, raw_path string, content string")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    return lambda text, t: con.execute(oracle._with(text, overall_thresh=t)).fetchall()


@pytest.mark.parametrize("prune,thresh,block", [(False, 0.05, 2000), (True, 0.05, 2000), (True, 0.3, 2), (False, 0.0, 2)])
def test_pairs_and_flagged_equal_sql(spark, sql, prune, thresh, block):
    a = _fixture(spark, overall_thresh=thresh, prune=prune, block_rows=block)
    got = {(r["id_a"], r["id_b"]): r["overall"] for r in a.pairs.collect()}
    assert got == pytest.approx({(x, y): o for x, y, o in sql("SELECT id_a, id_b, overall FROM pairs", thresh)}, abs=1e-12)
    flagged = [(r["id_a"], r["id_b"], r["rank"], r["path_a"], r["path_b"]) for r in a.flagged_files.collect()]
    assert sorted(flagged) == sorted(sql("SELECT id_a, id_b, rank, path_a, path_b FROM flagged", thresh))


def test_pairs_come_best_first(spark):
    rows = _fixture(spark, overall_thresh=0.05).pairs.collect()
    keys = [(-r["overall"], r["id_a"], r["id_b"]) for r in rows]
    assert len(keys) > 3 and keys == sorted(keys)


@pytest.mark.parametrize("prune", [False, True])
def test_hand_computed_corpus(spark, prune):
    tpl = "/* starter */\n" + "\n".join(f"int v{i} = {i};" for i in range(12)) + "\n"
    rows = [(0, "alice", "alice/main.py", BODY), (0, "alice", "alice/blank.py", EMPTY), (0, "alice", "alice/T.java", tpl),
            (0, "alice", "alice/util.py", OTHER),
            (1, "bob", "bob/renamed.py", BODY), (1, "bob", "bob/blank.py", EMPTY),
            (1, "bob", "bob/util.py", OTHER.replace("total", "t").replace("item", "u")), (1, "bob", "bob/short.py", "a = 1\n"),
            (2, "carol", "carol/T.java", "// mine\n" + tpl), (2, "carol", "carol/x/util.py", OTHER),
            (3, "dave", "dave/readme.txt", "hello\n")]
    template = spark.createDataFrame([("t/T.java", tpl)], "raw_path string, content string")
    # alice-bob: a renamed copy and an empty common file 1.0 each, util.py shares nothing; alice-carol: one moved copy
    want = {(0, 1): 2 / 3, (0, 2): 1.0, (0, 3): 0.0, (1, 2): 0.0, (1, 3): 0.0, (2, 3): 0.0}
    for thresh in (0.0, 0.3, 0.7):
        a = analyze(_files(spark, rows), template, overall_thresh=thresh, prune=prune)
        got = {(r["id_a"], r["id_b"]): r["overall"] for r in a.pairs.collect()}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= thresh})
    subs = {r["submission"]: r for r in a.submissions.collect()}
    assert subs["dave"]["total_lines"] == 0 and subs["dave"]["template_pct"] == 0.0
    assert (subs["carol"]["total_lines"], subs["carol"]["student_lines"]) == (13 + 1 + 12, 12)


@pytest.mark.parametrize("block", [2, 2000])
def test_copies_and_a_shingle_in_every_file(spark, block):
    rows = [(10 + 3 * i, f"s{i}", f"s{i}/f{i % 3}.py", BODY) for i in range(6)]
    rows.append((90, "s6", "s6/g.py", BODY.replace("row_5", "col_5")))   # one token changed: 5 of 48 shingles differ
    a = analyze(_files(spark, rows), overall_thresh=0.0, block_rows=block)
    got = {(r["id_a"], r["id_b"]): r["overall"] for r in a.pairs.collect()}
    ids = [r[0] for r in rows]
    assert got == pytest.approx({(x, y): 43 / 53 if y == 90 else 1.0 for i, x in enumerate(ids) for y in ids[i + 1:]})


def test_blocks_never_change_the_result(spark):
    a = _fixture(spark, overall_thresh=0.05)
    for f in (lambda b: S.shared_shingle_counts(a.reps, a.sets, b), lambda b: S.same_path_pairs(a.sets, b),
              lambda b: S.pairs_at_least(a.reps, a.sets, 0.3, b).drop("kind")):
        x, y = f(2), f(10**6)
        assert x.count() > 0 and x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_thresholds_are_exact(spark):
    """similarity 43/53 is attained: kept at that threshold, gone at the next representable one."""
    import math

    rows = [(0, "a", "a/x.py", BODY), (1, "b", "b/y.py", BODY.replace("row_5", "col_5"))]
    a = analyze(_files(spark, rows), overall_thresh=0.1)
    tau = 43 / 53
    assert S.pairs_at_least(a.reps, a.sets, tau).count() == 1
    assert S.pairs_at_least(a.reps, a.sets, math.nextafter(tau, 1)).count() == 0
    copies = analyze(_files(spark, [(0, "a", "a/x.py", BODY), (1, "b", "b/y.py", BODY)]), overall_thresh=0.1)
    assert S.pairs_at_least(copies.reps, copies.sets, 1.0).count() == 1
    assert S.pairs_at_least(copies.reps, copies.sets, 1.5).count() == 0
    for prune in (False, True):
        assert analyze(_files(spark, rows), overall_thresh=tau, prune=prune).pairs.count() == 1


def test_every_template_entry_counts(spark):
    tpl = spark.createDataFrame([("t/a.py", BODY), ("t/a.py", OTHER)], "raw_path string, content string")
    a = analyze(_files(spark, [(5, "a", "a/m.py", BODY), (9, "b", "b/n.py", OTHER)]), tpl)
    assert a.template_hashes.count() == 2 and a.flags.where("is_kept").count() == 0


def test_any_unique_ids(spark):
    rows = [(i, f"s{i}", f"s{i}/f.py", BODY) for i in (1, 17, 5 * 10**9)]
    a = analyze(_files(spark, rows), overall_thresh=0.0)
    assert sorted((r["id_a"], r["id_b"]) for r in a.overall.collect()) == [(1, 17), (1, 5 * 10**9), (17, 5 * 10**9)]


def test_no_input_is_an_error(spark):
    with pytest.raises(ValueError):
        analyze(_files(spark, []))


def test_partition_count_invariance(spark):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return sorted((r["id_a"], r["id_b"], round(r["overall"], 12)) for r in _fixture(spark, overall_thresh=0.05).pairs.collect())
    try:
        assert run(1) == run(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_overall_bounded_by_max_similarity(spark):
    a = _fixture(spark, overall_thresh=0.0)
    mx = a.file_similarities.groupBy("id_a", "id_b").agg(F.max("similarity").alias("mx"))
    assert a.overall.join(mx, ["id_a", "id_b"]).where(F.col("overall") > F.col("mx") + 1e-9).count() == 0


def test_written_tables_equal_lazy_and_can_be_deleted(spark):
    lazy, kept = _fixture(spark, overall_thresh=0.05, persist=False), _fixture(spark, overall_thresh=0.05)
    assert sorted(lazy.pairs.collect()) == sorted(kept.pairs.collect()) and not lazy.written
    paths = [p.removeprefix("file:") for p in kept.written]
    assert paths and all(map(os.path.isdir, paths))
    kept.cleanup()
    assert not any(map(os.path.exists, paths))


def test_the_session_is_left_alone(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.session.timeZone")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "123456")
    try:
        _fixture(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "123456"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_exact_keys_equal_hashed(spark):
    assert sorted(_fixture(spark, overall_thresh=0.05).pairs.collect()) == sorted(_fixture(spark, overall_thresh=0.05, exact_keys=True).pairs.collect())


def test_compat_strip_keeps_its_rule(spark):
    rows = [(0, "a", "main.py", "x = 'q'\n" * 12), (1, "b", "b/x.py", BODY), (1, "b", "b/y.py", OTHER)]
    paths = {(r["submission_id"], r["path"], r["ext"]) for r in analyze(_files(spark, rows), compat_strip=True).flags.collect()}
    assert paths == {(0, "", ""), (1, "x.py", "py"), (1, "y.py", "py")}


def test_params_defaults():
    p = Params()
    assert (p.shingle_size, p.file_thresh, p.cross_thresh, p.overall_thresh, p.min_lines) == (5, 0.6, 0.7, 0.4, 10)
    assert p.prune is False
    with pytest.raises(ValueError):
        Params(block_rows=0)


def test_minhash_estimates_are_near(spark):
    a = _fixture(spark, overall_thresh=0.05)
    rows = a.minhash_estimates.collect()
    assert rows and all(abs(r["estimate"] - r["similarity"]) <= 4 * 0.5 / 128 ** 0.5 for r in rows)   # four standard errors


def test_tfidf_cosine_by_hand(spark):
    import math

    rows = [(0, "a", "a/x.py", "p q\n" * 10), (1, "b", "b/x.py", "p q\n" * 10), (2, "c", "c/x.py", "p r\n" * 10)]
    got = {(r["id_a"], r["id_b"]): r["cosine"] for r in analyze(_files(spark, rows), overall_thresh=0.0).tfidf_cosine.collect()}
    p, q, r = (math.log(4 / (1 + d)) + 1 for d in (3, 2, 1))
    c = p * p / math.sqrt((p * p + q * q) * (p * p + r * r))
    assert got == pytest.approx({(0, 1): 1.0, (0, 2): c, (1, 2): c})
