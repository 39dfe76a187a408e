import base64
import gzip
import hashlib
import random
import zlib

import pytest

from codesim.llm import warc as W


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, sha string, last int")


def brute(rows, least=0):
    last = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= least and i is not None:
            last[p] = max(i, last.get(p, i))
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        target = last.get(p) if len(p) >= least else None
        ref = None if target is None or target == i else target
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nInjected: 1", "<p>x</p>"), (3, None, None), (4, "http://d/ä", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 50), (6, "u", "big " * 400_000), (7, "u", "big " * 400_000), (7, "u", "big " * 400_000), (None, "u", "<p>x</p>"), (None, "u", "alone")]


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    rows = ROWS + [(100 + i, f"http://h/{i}", random.Random(i % 40).randbytes(200).hex()) for i in range(120)]
    got = W.round_trip(pages_of(spark, rows).repartition(3), least).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(rows, least)


def test_empty_table(spark):
    assert W.round_trip(pages_of(spark, [])).count() == 0


def test_members_and_index(spark, tmp_path):
    src, dst = f"{tmp_path}/m", f"{tmp_path}/n"
    archives = W.write(W.roles(pages_of(spark, ROWS).coalesce(1)), src)
    archives = spark.createDataFrame(archives.collect(), archives.schema)
    name, n, size = W.normalise(archives, src, dst).first()
    whole = gzip.decompress(open(f"{src}/{name}", "rb").read())
    again = open(f"{dst}/{name}", "rb").read()
    assert gzip.decompress(again) == whole and len(again) == size
    lines = [x.split(b"\t") for x in open(f"{dst}/index/{name}.idx", "rb").read().splitlines()]
    assert len(lines) == n == len(ROWS)
    parts = [zlib.decompress(again[int(a):int(a) + int(k)], 31) for a, k, *_ in lines]
    assert b"".join(parts) == whole and all(p.startswith(b"WARC/1.1\r\n") for p in parts)


def test_streams_in_members_and_damage():
    data = [b"a" * 700_000, b"", b"b" * 10]
    raw = b"".join(gzip.compress(x) for x in data)
    reader = lambda raw: (lambda view: lambda n: bytes(view.read(n)))(__import__("io").BytesIO(raw))
    blocks = list(W.inflated(reader(raw)))
    assert b"".join(blocks) == b"".join(data) and max(map(len, blocks)) <= W.BLOCK
    with pytest.raises(ValueError):
        list(W.inflated(reader(gzip.compress(random.Random(1).randbytes(5000))[:-100])))


def test_a_task_run_again_replaces_its_file(tmp_path, monkeypatch):
    """Stores that don't move onto a file: the second attempt's file takes the first one's place, and no other file stays."""
    from pyarrow import fs

    class Strict:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            return getattr(self.real, name)

        def move(self, a, b):
            if self.real.get_file_info(b).type != fs.FileType.NotFound:
                raise OSError(f"{b} exists")
            self.real.move(a, b)

    monkeypatch.setattr(W, "_place", lambda folder: (Strict(fs.LocalFileSystem()), folder))
    for body in (b"first", b"second"):
        with W._Moved(str(tmp_path), "x.gz") as out:
            out.write(body)
    assert [p.name for p in tmp_path.iterdir()] == ["x.gz"] and (tmp_path / "x.gz").read_bytes() == b"second"
    with pytest.raises(ZeroDivisionError):
        with W._Moved(str(tmp_path), "x.gz") as out:
            1 / 0
    assert [p.name for p in tmp_path.iterdir()] == ["x.gz"] and (tmp_path / "x.gz").read_bytes() == b"second"
