"""Shingle keys are shuffled once, as arrays, and written only where classes share them; texts are dealt out only if the reader can't split them."""

import random

import pytest
from pyspark.sql import functions as F

from codesim import analyze
from codesim.operators import similarity as S
from codesim.plans import analyze as plan
from codesim.sources import fixture

FILES = "submission_id long, submission string, raw_path string, content string"


def _text(seed: int, lines: int) -> str:
    rng = random.Random(seed)
    return "".join(f"x{rng.randrange(30)} = y{rng.randrange(30)} + {i % 7}\n" for i in range(lines))


def _files(spark):
    """Copies, near copies, short files, empty ones, a template, a name that comes twice with different texts, and rows without a name or number."""
    rows = []
    for s in range(5):
        rows += [(s, f"s{s}", f"s{s}/copy{p}.py", _text(p, 30)) for p in range(3)]
        rows += [(s, f"s{s}", f"s{s}/near.py", _text(0, 30) + _text(100 + s, 10)), (s, f"s{s}", f"s{s}/short.py", _text(s, 3)), (s, f"s{s}", f"s{s}/empty.py", "\n" * 12),
                 (s, f"s{s}", f"s{s}/base.c", _text(50, 20)), (s, f"s{s}", f"s{s}/twice.js", _text(200 + s, 20)), (s, f"s{s}", f"s{s}/twice.js", _text(0, 4))]
    rows += [(None, "none", "none/a.py", _text(0, 30)), (3, "s3", None, _text(0, 30))]
    return spark.createDataFrame(rows, FILES), spark.createDataFrame([("t/base.c", _text(50, 20))], "raw_path string, content string")


def _sets(reps):
    return {(r.cls_hi, r.cls_lo): (r.n, r.members, sorted(r["keys"])) for r in reps.collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_shared_keys_equal_shared_sets(spark, parts):
    rng = random.Random(3)
    hot = [rng.getrandbits(64) - 2**63 for _ in range(40)]
    sets = [[7, *rng.sample(hot, rng.randint(0, 20)), *(rng.getrandbits(64) - 2**63 for _ in range(5))] for _ in range(30)] + [[], None, [rng.getrandbits(60)]]
    reps = spark.createDataFrame([(rng.randrange(2**60), c, len(k or []), 1 + c % 3, k) for c, k in enumerate(sets)], "cls_hi long, cls_lo long, n long, members long, keys array<long>").localCheckpoint()
    want = {tuple(r) for r in reps.transform(S.shared_sets).withColumn("keys", F.col("keys").cast("string")).collect()}
    got = S.shared_keys(reps.drop("keys"), reps, parts)
    assert got.columns == ["cls_hi", "cls_lo", "n", "members", "keys"]
    assert len(want) == 30 and want == {tuple(r) for r in got.withColumn("keys", F.col("keys").cast("string")).collect()}
    # a class that comes twice counts its keys once
    twice = {r.cls_lo: r["keys"] for r in S.shared_keys(reps.drop("keys"), reps.unionByName(reps), parts).collect()}
    assert all(len(set(k)) == len(k) and set(k) == set(sets[c]) for c, k in twice.items())


@pytest.mark.parametrize("names,more", [(10, {}), (0, {"scan_partitions": 3, "min_tokens": 120}), (10**6, {"compat_strip": True, "exact_keys": True})])
def test_keys_of_a_file_of_each_class(spark, names, more, monkeypatch):
    """The list of the files that are read again is broadcast or not."""
    monkeypatch.setattr(plan, "NAMES_MOST", names)
    a, lazy = (analyze(*_files(spark), persist=p, **more) for p in (True, False))
    held = a.keyed.groupBy(*S.CLS).count()
    assert [r["count"] for r in held.join(a.classes, S.CLS).collect()] == [1] * a.classes.count()
    assert held.count() <= a.classes.count() + 1  # the short text under a repeated name
    want = _sets(lazy.reps)
    assert len(want) > 3 and _sets(a.reps) == want
    fresh = analyze(*_files(spark), **more)
    assert _sets(fresh.shared) == _sets(S.shared_sets(lazy.reps))
    a.cleanup()
    fresh.cleanup()


def test_only_shared_keys_are_written(spark):
    a = analyze(*_files(spark), overall_thresh=0.1)
    assert a.pairs.count() and a.line_overlap.count() and a.minhash_estimates.count() and a.side_by_side.count()
    assert {w.rsplit("/", 1)[1].rsplit("-", 1)[0] for w in a.written if "keys" in spark.read.parquet(w).columns} <= {"shared_sets", "left_shared_sets"}
    a.cleanup()


def test_texts_are_dealt_out_only_if_the_reader_cannot(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    cores = spark.sparkContext.defaultParallelism
    assert cores > 2
    for name, files, want in (("one", 1, cores), ("many", 2 * cores, 0)):
        docs.repartition(files).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        held = spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.openCostInBytes", str(2**27))  # a partition a file
        try:
            assert fixture.to_deal(spark, f"{tmp_path}/{name}") == want
        finally:
            spark.conf.set("spark.sql.files.openCostInBytes", held)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert fixture.to_deal(spark, f"{tmp_path}/none") == 0
