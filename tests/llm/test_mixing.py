import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from codesim.llm import mixing as M
from codesim.llm.oracle import OP12


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows, weights=(5, 2, 1), limit=3):
    """Share by weight, cut at the limit, share the excess again, until nothing is above."""
    own = Counter()
    for _, text, _, source in rows:
        own[source] += size(text)
    order = sorted((s for s in own if s is not None), key=lambda s: s.encode()) + [None] * (None in own)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(own.values()), set()
    while True:
        left = total - sum(limit * own[s] for s in full)
        free = [s for s in own if s not in full]
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > limit * own[s]}
        if not over:
            return {s: Fraction(limit * own[s]) if s in full else share[s] for s in own}, own
        full |= over


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(1500):
        source = rng.choices(["a", "b", "B", "c", "é", None, "", "tiny", "zero"], [60, 9, 8, 8, 6, 4, 3, 1, 1])[0]
        out.append((i, None if source == "zero" else "x y\tz\x0b " * rng.randint(0, 40) + "w" * rng.randint(0, 3), "en", source))
    out += [(2000, "long " * 20_000, "en", "a"), (None, "no id", "en", "b"), (None, "no id", "en", "b")]
    return out + [(7777, "the same words again", "en", "a")] * 400 + [(7777, "other", "en", "a")] * 3


def result(df):
    return Counter((r.doc_id, r.source, r.size, r.source_size, r.target, r.copies, r.taken) for r in df.collect())


def test_targets_and_sampling(spark, docs_of, rows):
    got = M.copies(docs_of(rows)).collect()
    want, own = brute_targets(rows)
    assert len(got) == len(rows) and {r.source for r in got} == set(own)
    taken, longest = Counter(), defaultdict(int)
    for r in got:
        assert r.source_size == own[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12, abs=1e-9)
        rate = want[r.source] / own[r.source] if own[r.source] else 0
        assert rate // 1 <= r.copies <= -(-rate // 1) <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert sum(want.values()) == sum(own.values())
    for s, t in want.items():
        assert abs(taken[s] - t) <= longest[s] + 1


def test_systematic_sampling_by_the_definition(spark, docs_of, rows):
    """Documents in order of size, running sums of the rate, one offset, an emission per integer crossed."""
    got = M.copies(docs_of(rows)).where("source = 'b'").collect()
    import hashlib

    offset = int(hashlib.md5(b"mix|b").hexdigest()[:8], 16) / 2**32
    rate = got[0].target / got[0].source_size
    order = sorted(((r.size, hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest(), r.copies) for r in got))
    for i, (_, _, copies) in enumerate(order):
        assert copies == int((i + 1) * rate + offset) - int(i * rate + offset)


def test_reruns_and_bounds_agree(spark, docs_of, rows):
    docs = docs_of(rows)
    first = result(M.copies(docs))
    assert result(M.copies(docs.repartition(13, F.rand(3)))) == first
    assert result(M.copies(docs.coalesce(1), max_broadcast=0)) == first


def test_sql_agrees(spark, docs_of, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    want = Counter((d, s, z, w, t, c, k) for d, s, z, w, t, c, k in con.execute(OP12).fetchall())
    assert result(M.copies(docs_of(rows))) == want


def test_mixed_rows(spark, docs_of, rows):
    docs = docs_of(rows).withColumn("nth", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("_copies", F.lit(2)).withColumn("copies", F.lit(9))
    got = M.mixed(docs)
    assert got.columns == docs.columns
    want = Counter()
    for r in M.copies(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    assert Counter((r.doc_id, r.source, size(r.text)) for r in got.collect()) == +want
    again = Counter(r.text for r in got.where("doc_id = 7777 AND text <> 'other'").collect())
    assert sum(again.values()) == want[7777, "a", 4]


def test_empty_and_wordless_tables(spark, docs_of):
    assert M.copies(docs_of([])).count() == 0 and M.mixed(docs_of([])).count() == 0
    assert [(r.size, r.target, r.taken) for r in M.copies(docs_of([(1, None, "en", None)])).collect()] == [(0, 0.0, 0)]


def test_no_python_on_the_main_path(spark, docs_of, capsys):
    M.copies(docs_of([(1, "x y", "en", "a")])).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
