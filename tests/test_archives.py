"""Archive round trip (S1-S6) with small zip files written by the test."""

import zipfile

import pytest
from pyspark.sql import functions as F

from codesim import analyze
from codesim.sources.archives import read_archives, read_template

BODY = "\n".join(f"value_{i} = compute(item_{i}, {i})" for i in range(14)) + "\n"


def _zip(path, entries, dirs=()):
    with zipfile.ZipFile(path, "w") as zf:
        for d in dirs:
            zf.writestr(zipfile.ZipInfo(d), b"")
        for name, data in entries:
            zf.writestr(name, data)


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    d = tmp_path_factory.mktemp("zips")
    _zip(d / "alice.zip", [("alice/src/main.py", BODY.encode()), ("alice/node_modules/x.py", BODY.encode()),
                           ("alice/src/main.py", (BODY + "# v2\n").encode()),
                           ("alice/src/Bad.PY", b"x = 1\n\xff\xfe oops\n" * 6),
                           ("alice/notes.md", b"hello")], dirs=["alice/", "alice/src/"])
    _zip(d / "bob.tar.ZIP", [("bob/main.py", BODY.encode()), ("bob/build/gen.py", BODY.encode())])
    (d / "broken.zip").write_bytes(b"PK\x03\x04 truncated")
    (d / "readme.txt").write_text("not an archive")
    t = tmp_path_factory.mktemp("tpl")
    _zip(t / "starter.zip", [("starter/main.py", b"# different comment\n" + BODY.encode())])
    return d, t


def test_read_permissive(spark, archives):
    d, _ = archives
    a = read_archives(spark, str(d), mode="PERMISSIVE")
    roster = {r["submission"]: r["submission_id"] for r in a.roster.collect()}
    assert set(roster) == {"alice", "bob.tar", "broken"}
    assert sorted(roster.values()) == [0, 1, 2]
    files = {(r["submission"], r["raw_path"]): r["content"] for r in a.files.collect()}
    assert set(files) == {("alice", "alice/src/main.py"), ("alice", "alice/src/Bad.PY"), ("bob.tar", "bob/main.py")}
    assert files[("alice", "alice/src/main.py")].endswith("# v2\n")          # last entry wins
    assert "�" in files[("alice", "alice/src/Bad.PY")]                  # invalid UTF-8 replaced
    rej = a.rejects.collect()
    assert [r["submission"] for r in rej] == ["broken"]


def test_failfast(spark, archives):
    d, _ = archives
    with pytest.raises(Exception):
        read_archives(spark, str(d)).files.collect()


def test_archive_analysis(spark, archives):
    d, t = archives
    a = read_archives(spark, str(d), mode="PERMISSIVE")
    tpl = read_template(spark, str(t))
    res = analyze(a.files, tpl, roster=a.roster, overall_thresh=0.0)
    subs = {r["submission"]: r for r in res.submissions.collect()}
    assert subs["broken"]["total_lines"] == 0
    # bob's main.py equals the template after normalisation -> not kept
    assert subs["bob.tar"]["student_lines"] == 0 and subs["bob.tar"]["template_pct"] == 100.0
    paths = {r["path"] for r in res.facts.where(F.col("submission_id") == 0).collect()}
    assert paths == {"src/main.py", "src/Bad.PY"}
    assert res.pairs.count() == 3


def _flip(path, at, xor):
    data = bytearray(path.read_bytes())
    for i in at(bytes(data)):
        data[i] ^= xor
    path.write_bytes(bytes(data))


def test_every_kind_of_damage_is_a_reject_without_files(spark, tmp_path):
    two = [("c/one.py", BODY.encode()), ("c/two.py", (BODY * 3).encode())]
    for name in ("crc", "encrypted", "method", "fine"):
        _zip(tmp_path / f"{name}.zip", two)
    _flip(tmp_path / "crc.zip", lambda b: [b.rindex(b"value_9")], 1)                       # the second entry's bytes
    flags = lambda b: [i + k for sig, k in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)) for i in _all(b, sig)]
    _flip(tmp_path / "encrypted.zip", flags, 1)
    method = lambda b: [i + k for sig, k in ((b"PK\x03\x04", 8), (b"PK\x01\x02", 10)) for i in _all(b, sig)]
    _flip(tmp_path / "method.zip", method, 99)
    a = read_archives(spark, str(tmp_path), mode="PERMISSIVE")
    assert sorted(r["submission"] for r in a.rejects.collect()) == ["crc", "encrypted", "method"]
    assert {r["submission"] for r in a.files.collect()} == {"fine"} and a.files.count() == 2


def _all(data, sig):
    at = data.find(sig)
    while at >= 0:
        yield at
        at = data.find(sig, at + 1)


def test_template_keeps_repeated_names(spark, tmp_path):
    _zip(tmp_path / "t.zip", [("t/a.py", BODY.encode()), ("t/a.py", (BODY + "more = 1\n").encode())])
    assert read_template(spark, str(tmp_path)).count() == 2
