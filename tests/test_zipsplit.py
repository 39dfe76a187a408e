"""The split archive source against the whole-file source and the standard library."""

import re
import io
import random
import warnings
import zipfile

import pytest
from pyspark.sql import functions as F

from codesim.params import Params
from codesim.sources import archives, zipsplit

SIGNATURE = b"PK\x03\x04"


def archive(entries, comment=b"", before=b""):
    """entries: (name, data, method)."""
    blob = io.BytesIO(before)
    blob.seek(0, 2)
    with zipfile.ZipFile(blob, "a" if before else "w") as zf, warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for name, data, method in entries:
            zf.writestr(zipfile.ZipInfo(name), data, method)
        zf.comment = comment
    return blob.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(1)
    d = tmp_path_factory.mktemp("split")
    nested = archive([("in.py", rng.randbytes(300), 0), ("b.py", b"x" * 50, 8)])
    noise = lambda n: rng.randbytes(n)
    methods = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]
    large = [(f"p{i % 40}/f{i % 170}.py", rng.choice([noise, lambda n: b"ab c\n" * n])(rng.choice([0, 1, 30, 3000, 20_000])), methods[i % 4]) for i in range(400)]
    large += [("n/nested.java", nested, 0), ("n/two.c", nested + SIGNATURE + SIGNATURE + nested, 0), ("n/end.sql", noise(70) + SIGNATURE, 0), ("n/", b"", 0), ("build/x.py", b"no", 0), ("x.md", b"no", 8)]
    (d / "large.zip").write_bytes(archive(large))
    (d / "led.zip").write_bytes(archive([("a.py", b"1" * 500, 8), ("b.py", noise(2000), 0)], before=b"#!/bin/sh\n" + SIGNATURE + b"stub" * 30))
    (d / "said.ZIP").write_bytes(archive([("a.py", b"one", 8)], comment=b"a comment with " + SIGNATURE + b" in it"))
    (d / "named.zip").write_bytes(archive([("a" + SIGNATURE.decode() + "b.py", b"odd name", 0), ("c.py", b"plain", 0)]))
    (d / "none.zip").write_bytes(archive([]))
    (d / "sub").mkdir()
    (d / "sub" / "x [1].zip").write_bytes(archive([("é/ü.py", "ä".encode() * 400, 8)]))
    return d


def rows(df):
    return sorted(((r.path, r.raw_path, bytes(r.data) if r.data is not None else None, r.entry_ordinal, r.error) for r in df.collect()), key=str)


@pytest.mark.parametrize("split", ["32k", "1m"])
@pytest.mark.parametrize("all_entries", [False, True])
def test_same_rows_as_the_whole_reader(spark, folder, split, all_entries):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = rows(zipsplit.expand(spark, str(folder), all_entries=all_entries))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = rows(archives.expand(archives.list_archives(spark, str(folder)), all_entries=all_entries))
    assert len(want) > 170 and got == want


def test_few_wanted_entries_and_shuffled_joins_agree(spark, folder):
    want = rows(archives.expand(archives.list_archives(spark, str(folder))))
    assert rows(zipsplit.expand(spark, str(folder), Params(broadcast_rows=0))) == want


def test_one_archive_is_read_by_many_tasks(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found = zipsplit._rows(spark, str(folder / "large.zip"))
        held = found.select("block", F.octet_length("data").alias("n"), F.spark_partition_id().alias("p")).collect()
        base, starts, _ = zipsplit.blocks(found)
        at = {r["at"] for r in starts.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    blob = (folder / "large.zip").read_bytes()
    assert len({r["p"] for r in held}) > 5 and sum(r["n"] + 4 for r in held) == len(blob) + 4
    assert at - {-4} == {i for i in range(len(blob)) if blob.startswith(SIGNATURE, i)}
    with zipfile.ZipFile(io.BytesIO(blob)) as zf:
        assert {x.header_offset for x in zf.infolist()} <= at


def test_broken_archives(spark, tmp_path):
    good = archive([("a.py", b"fine " * 100, 8), ("b.py", b"more " * 100, 0)])
    (tmp_path / "good.zip").write_bytes(good)
    (tmp_path / "crc.zip").write_bytes(good.replace(b"more more", b"mOre more", 1))
    (tmp_path / "cut.zip").write_bytes(good[:-30])
    (tmp_path / "no.zip").write_bytes(b"no archive at all")
    (tmp_path / "lost.zip").write_bytes(good.replace(SIGNATURE, b"PKxx", 1))
    got = zipsplit.expand(spark, str(tmp_path), mode="PERMISSIVE").collect()
    files = sorted((r.path.rsplit("/")[-1], r.raw_path) for r in got if r.error is None)
    assert files == [("good.zip", "a.py"), ("good.zip", "b.py")]
    whole = archives.expand(archives.list_archives(spark, str(tmp_path)), mode="PERMISSIVE").where("error IS NOT NULL").collect()
    assert {r.path.rsplit("/")[-1] for r in got if r.error} == {"crc.zip", "cut.zip", "no.zip", "lost.zip"} == {r.path.rsplit("/")[-1] for r in whole}
    assert next(r.error for r in got if r.path.endswith("crc.zip")) == next(r.error for r in whole if r.path.endswith("crc.zip"))
    with pytest.raises(Exception, match="CRC|zip"):
        zipsplit.expand(spark, str(tmp_path)).collect()


def test_read_archives_by_ranges(spark, folder):
    a, b = (archives.read_archives(spark, str(folder), split=s) for s in (False, True))
    assert sorted(map(tuple, a.files.collect())) == sorted(map(tuple, b.files.collect())) and a.roster.collect() == b.roster.collect()
    t, u = (archives.read_template(spark, str(folder), split=s) for s in (False, True))
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, u.collect()))


def test_bytes_do_not_follow_their_block(spark, tmp_path):
    """The starts of blocks are few however many entries are wanted, so they come to the rows."""
    import contextlib
    import io
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as zf:
        for i in range(9):
            zf.writestr(f"d/f{i}.py", f"x = {i}\n" * 50 + ("PK\x03\x04" if i % 3 == 0 else ""), zipfile.ZIP_STORED)
    df, out = zipsplit.expand(spark, str(tmp_path), Params(broadcast_rows=2)), io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    assert "Exchange" in out.getvalue() and not re.search(r"hashpartitioning\(file#\d+, block#\d+", out.getvalue())
    got = {r.raw_path: bytes(r.data) for r in df.collect()}
    assert got == {f"d/f{i}.py": (f"x = {i}\n" * 50 + ("PK\x03\x04" if i % 3 == 0 else "")).encode() for i in range(9)}
