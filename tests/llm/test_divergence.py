import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from codesim.llm import divergence as D
from codesim.llm.oracle import OP11

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, limit=200):
    docs = [(lang or "", source or "", TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in df if df[t] >= 3]
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= 3) for s in {d[1] for d in mine}}
        whole = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        def f(a, b, t):
            return (p(a, t) - p(b, t)) ** 2 // p(b, t)

        for s, c in count.items():
            pairs = [(sum(f(c, o, t) for t in kept), x) for x, o in count.items() if x != s]
            terms = [(f(c, whole, t), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, x, v, i + 1) for i, (v, x) in enumerate(found) if part == "pair" or i < limit}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(10)] + ["Élan", "ÄB", "übel", "naïve", "日本", "àb"]
    out = []
    for i in range(240):
        source = rng.choices(["s1", "s2", "s3", "S", "é", None, ""], [9, 2, 2, 1, 1, 1, 1])[0]
        lang = rng.choice(["en", "en", "de", None])
        out.append((i, " ".join(rng.choices(vocabulary[:40] if source == "s2" else vocabulary, k=rng.randint(0, 25))).replace("wa", "WA"), lang, source))
    out += [(900, None, "en", "s9"), (901, "", "xx", "s1"), (902, "only once here", "xx", "s2"), (903, "alone alone", "yy", "s1"), (904, "alone", "yy", "s1"), (905, "Alone!", "yy", "s1")]
    return out + [out[0]] * 3 + [(910, "wab " * 30_000, "de", "s1")]


@pytest.mark.parametrize("bound", [100_000, 0])
@pytest.mark.parametrize("limit", [200, 7])
def test_equals_brute_force(spark, docs_of, rows, bound, limit):
    got = D.audit(docs_of(rows), limit=limit, max_broadcast=bound)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == brute(rows, limit)


def test_sql_equals_brute_force(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    assert set(con.execute(OP11).fetchall()) == brute(rows)


def test_large_counts_stay_exact(spark):
    row = spark.range(1).selectExpr("30000000000L AS c", "90000000001L AS n", "7L AS v").select(D._p("c", "n", "v")).first()
    assert row[0] == 1 + 10**9 * 30_000_000_001 // 90_000_000_008


def test_large_counts_stay_exact_in_blocks():
    c = np.array([[3, 40_000_000_000], [9_500_000_000, 0]])
    total = np.array([90_000_000_008, 120_000_000_001])
    assert D._shares(c, total[None, :]).tolist() == [[1 + 10**9 * (int(x) + 1) // int(t) for x, t in zip(row, total)] for row in c]


def test_sums_sent_early(spark, docs_of, rows, monkeypatch):
    monkeypatch.setattr(D, "HELD", 5)
    assert {tuple(r) for r in D.audit(docs_of(rows)).collect()} == brute(rows)


def test_empty_tables(spark, docs_of):
    assert D.audit(docs_of([])).count() == 0
    assert {tuple(r) for r in D.audit(docs_of([(1, None, "en", "a"), (2, "", "en", "b")])).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
