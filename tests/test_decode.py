"""Character sets told by bytes."""

import random

import pytest

from codesim.functions import decode
from codesim.sources import archives

TEXT = "naïve café: \u20ac 5, “quoted” — ok\nline two\n"
CASES = [
    (None, None, None), (b"", "UTF-8", ""), (b"plain", "UTF-8", "plain"), ("é日本😀".encode(), "UTF-8", "é日本😀"),
    ("\ufeffé".encode(), "UTF-8", "é"), (TEXT.encode("cp1252"), "windows-1252", TEXT), ("café".encode("latin-1"), "windows-1252", "café"),
    (b"\xff\xfe" + "é😀x".encode("utf-16le"), "UTF-16LE", "é😀x"), (b"\xfe\xff" + "日本".encode("utf-16be"), "UTF-16BE", "日本"),
    (TEXT.encode("utf-16le"), "UTF-16LE", TEXT), (TEXT.encode("utf-16be"), "UTF-16BE", TEXT),
    (TEXT.encode("utf-32"), "UTF-32LE", TEXT), (b"\0\0\xfe\xff" + TEXT.encode("utf-32be"), "UTF-32BE", TEXT),
    # damaged
    ("ä" .encode() * 20 + b"\xe4\xbd" + "ö".encode(), "UTF-8", "ä" * 20 + "\ufffdö"),
    (b"x = 1\n\xff\xfe oops", "windows-1252", "x = 1\nÿþ oops"),
    (b"\xff\xfea\0b", "UTF-16LE", "a\ufffd"), (b"\xfe\xff\xd8\x3d\x00a", "UTF-16BE", "\ufffda"),
    (b"\xfe\xff\xde\x00\xd8\x3d\xde\x00\xd8\x3d", "UTF-16BE", "\ufffd😀\ufffd"),
    (b"a\0b", "UTF-8", "a\0b"), (b"\xff\xfe\0\0\xff", "UTF-16LE", "\0\ufffd"),
    (("word " * 30_000 + "é").encode("utf-16le"), "UTF-16LE", "word " * 30_000 + "é"),
]


def test_charsets_and_texts(spark):
    rows = spark.createDataFrame([(i, b) for i, (b, _, _) in enumerate(CASES)], "i int, data binary")
    got = {r.i: (r.c, r.t) for r in rows.select("i", decode.charset("data").alias("c"), decode.decoded("data").alias("t")).collect()}
    for i, (b, c, t) in enumerate(CASES):
        assert got[i] == (c, t), (i, b and b[:40])


def test_random_bytes_never_fail(spark):
    rng = random.Random(5)
    heads = [b"", b"\xff\xfe", b"\xfe\xff", b"\xef\xbb\xbf", b"\xff\xfe\0\0", b"\0\0\xfe\xff"]
    data = [heads[i % 6] + rng.randbytes(rng.randint(0, 40)) for i in range(300)]
    data += [h + bytes(rng.choice([0, 0xD8, 0xDC, 0x61]) for _ in range(rng.randint(0, 30))) for h in heads for _ in range(30)]
    rows = spark.createDataFrame([(b,) for b in data], "data binary")
    out = rows.select("data", decode.charset("data").alias("c"), decode.decoded("data").alias("t")).collect()
    assert len(out) == len(data) and all(r.c and r.t is not None for r in out)
    for r in out:
        b = bytes(r.data)
        if r.c in ("UTF-16LE", "UTF-16BE"):
            try:
                want = b.decode(r.c).removeprefix("\ufeff")
            except UnicodeDecodeError:
                assert "\ufffd" in r.t
            else:
                assert r.t == want


def test_archives_detect(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as zf:
        zf.writestr("x.py", TEXT.encode("cp1252"))
        zf.writestr("y.py", "\ufeff".encode("utf-16le") + TEXT.encode("utf-16le"))
        zf.writestr("z.py", TEXT)
    for split in (False, True):
        files = archives.read_archives(spark, str(tmp_path), split=split, charset="detect").files.collect()
        assert {r.raw_path: r.content for r in files} == dict.fromkeys(("x.py", "y.py", "z.py"), TEXT)
    assert {r.content for r in archives.read_template(spark, str(tmp_path), charset="detect").collect()} == {TEXT}
    with pytest.raises(ValueError):
        archives.read_archives(spark, str(tmp_path), charset="latin")


def test_long_and_broken_units(spark):
    """Runs of units of any length, surrogates whole and lone, single last bytes, in both orders, against Python's decoder."""
    long = "grüße " * 200_000
    texts = [long, "a\U0001f600b", "語" * 50 + "x" * 200, "\U0001f600" * 2000]
    rows = [(f"{n}-{e}", t.encode(e), e.upper()) for n, t in enumerate(texts) for e in ("utf-16le", "utf-16be")]
    rows += [(f"odd-{e}", "abcdef".encode(e) + b"\x41", e.upper()) for e in ("utf-16le", "utf-16be")]
    want = {k: d[:len(d) // 2 * 2].decode(e) + "�" * (len(d) % 2) for k, d, e in rows}
    for e in ("utf-16le", "utf-16be"):
        lone = "ab".encode(e) + "\ud83d".encode(e, "surrogatepass") + "cd".encode(e)
        rows.append((f"lone-{e}", lone, e.upper()))
        want[f"lone-{e}"] = "ab�cd"
    df = spark.createDataFrame(rows, "k string, data binary, name string")
    got = {r.k: r.t for r in df.select("k", decode.text_in("data", "name").alias("t")).collect()}
    assert got == want
    told = {r.k: r.c for r in df.select("k", decode.charset("data").alias("c")).where("k in ('0-utf-16le', '0-utf-16be', '2-utf-16le')").collect()}
    assert told == {"0-utf-16le": "UTF-16LE", "0-utf-16be": "UTF-16BE", "2-utf-16le": "UTF-16LE"}


def test_well_formed_units_are_not_turned(spark):
    told = str(decode.text_in("data", "name"))
    assert "decode(data, 'UTF-16LE')" in told and "decode(data, 'UTF-16BE')" in told
