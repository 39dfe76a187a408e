import itertools
import random
import re
from collections import Counter

import pytest

from codesim.llm import url_rules as R


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = []
    for text, verdict in R.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(text), text, verdict))
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://A.ORG", "http://a.org/", "http://org/", "http://aorg/", "http://x.EXAMPLE.org/en/12?q=/es/#z", "http://example.org/en/2", "http://example.org/es/", "https://a.com/fr/x", "https://a.com/de/x?y=1&z", "https://com/de/", "ftp://a.com/d\ne/", "http://u:p@a.net:80/b://c/d.html", "x://É.ORG/\u3000", "http://example.org?x", "http://a.net/" + "p/" * 3000]


def table(spark, rows):
    return spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")


def test_parts_and_given_rules_equal_brute_force(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = list(enumerate(URLS)) + [(None, URLS[5]), (5, URLS[5])]
    got = R.judged(table(spark, rows), labels).collect()
    want = []
    for i, url in rows:
        host, path = brute_parts(url)
        rule, verdict = brute_rule(host, path)
        want.append((i, host, path, rule, verdict or "allow"))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(want, key=str)


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        t = set(rng.sample("abcdefg", rng.randint(1, 4)))
        bad = {"a", "b"} <= t or "g" in t and rng.random() < 0.9
        rows.append((sorted(t), bool(bad)))
    got = {tuple(r.antecedent): round(r.confidence, 9) for r in R.mined(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.8).collect()}
    every, bad = Counter(), Counter()
    for t, b in rows:
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(t, k):
                every[c] += 1
                bad[c] += b
    rules = {c: bad[c] / every[c] for c in every if bad[c] >= 0.02 * len(rows) and bad[c] >= 0.8 * every[c]}
    want = {c: round(v, 9) for c, v in rules.items() if not any(set(a) < set(c) and rules[a] >= v for a in rules)}
    assert got == want and ("a", "b") in got


@pytest.mark.parametrize("bound", [100_000, 0])
def test_matches_equal_brute_force(spark, bound):
    rng = random.Random(2)
    some = [([["a"], ["b"]], 0.9), ([["c", "h", "i"]], 0.95), ([["b"], ["d", "j"], ["e"]], 0.8)]
    rules = [([c[0] for c in x], p, 0.1, x, x[-1]) for x, p in some]
    urls = [(str(i), rng.sample("abcdefghij", rng.randint(0, 5))) for i in range(80)]
    got = {r.url for r in R.blocked(spark.createDataFrame(urls, "url string, tokens array<string>"), spark.createDataFrame(rules, "antecedent array<string>, confidence double, support double, any_of array<array<string>>, anchors array<string>"), bound).collect()}
    assert got == {u for u, t in urls if any(all(set(c) & set(t) for c in x) for x, _ in some)}


def test_tokens_that_always_stand_together_are_one(spark):
    """Twenty segments shared by all bad pages: each of them is a rule of its own, found without 2^20 item sets."""
    rng = random.Random(16)
    shared = [f"s{i:02}" for i in range(20)]
    rows = [([*shared, f"u{i % 3}"], True) for i in range(60)] + [(rng.sample(["x", "y", "z", "u0", "u1"], 2), False) for _ in range(60)]
    got = R.mined(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.8).collect()
    single = {t for r in got if len(r.any_of) == 1 for t in r.any_of[0]}
    assert single == {*shared, "u2"} and all(sum(t in w for w, _ in rows) for t in single)
    assert {tuple(r.antecedent): round(r.confidence, 9) for r in got} == {("s00",): 1.0, ("u2",): 1.0}
    urls = spark.createDataFrame([("1", ["s07", "q"]), ("2", ["q"]), ("3", ["u2"]), ("4", ["x", "u0"])], "url string, tokens array<string>")
    rules = R.mined(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.8)
    assert {r.url for r in R.blocked(urls, rules).collect()} == {"1", "3"}


def test_spam_hosts_are_learnt(spark, capsys):
    rng = random.Random(1)
    rows = [(i, f"http://{'cheap-pills' if i % 10 == 0 else rng.choice(['a', 'b', 'c'])}.example.net/en/{i}") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(0, 600) if i % 3] + [(None, 0, 0), (599, None, None)], "doc_id long, quality int, toxic int")
    out = R.judged(table(spark, rows), labels)
    assert all((r.verdict == "block") == (r.page_id % 10 == 0) for r in out.collect())
    out.explain()
    assert not re.search("Python|Pandas|Arrow|Cartesian", capsys.readouterr().out)


def test_empty_tables(spark):
    assert R.judged(table(spark, []), spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")).count() == 0
