import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from codesim.llm import pii as D


def luhn(number):
    d = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def values(df):
    return {r.v: r.p for r in df.select(F.col("text").alias("v"), D.pseudonym(F.col("text"), "k").alias("p")).collect()}


def test_feistel_is_a_permutation(spark):
    for a, b in ((7, 11), (1, 13), (189, 773)):
        out = [r.y for r in spark.range(a * b).select(D.feistel(F.col("id"), a, b, "key", "t").alias("y")).collect()]
        assert sorted(out) == list(range(a * b)) and out != sorted(out)
    other = [r.y for r in spark.range(77).select(D.feistel(F.col("id"), 7, 11, "other", "t").alias("y")).collect()]
    assert other != [r.y for r in spark.range(77).select(D.feistel(F.col("id"), 7, 11, "key", "t").alias("y")).collect()]


def test_formats_stay_valid(spark, docs_of):
    cards = ["4111111111111111", "5500 0000 0000 0004", "3782-822463-10005", "6011000990139424", "4222222222222"]
    phones = ["+1 (743) 555-3824", "(212) 555-1212", "212-555-1212", "1-800-555-0199"]
    ssns = ["123-45-6789", "899-01-0001", "665-99-9999", "667-01-0001"]
    dates = ["2020-02-29", "31/12/1999", "1800/01/01", "31.12.2199"]
    ips = ["0.0.0.0", "255.255.255.255", "17.252.227.210"]
    mails = ["hein.19@mail5.example.com", "A.b+C@x.org", "q@a.b"]
    got = values(docs_of(list(enumerate(cards + phones + ssns + dates + ips + mails))))
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
    for v in cards:
        assert luhn(got[v]) and shape(got[v]) == shape(v) and got[v][0] == v[0]
    for v in phones + ssns + dates:
        assert shape(got[v]) == shape(v)
    for v in phones:
        local = re.sub(r"\D", "", got[v])[-10:]
        assert local[0] in "23456789" and local[3] in "23456789"
    for v in ssns:
        a, g, s = got[v].split("-")
        assert a not in ("000", "666") and a < "900" and g != "00" and s != "0000"
    for v in dates:
        n = [int(x) for x in re.split(r"\D", got[v])]
        datetime.date(*(n if n[0] > 31 else n[::-1]))
    for v in ips:
        assert all(0 <= int(o) <= 255 for o in got[v].split("."))
    for v in mails:
        assert got[v].split("@")[1] == v.split("@")[1] and shape(got[v]) == shape(v)
    assert len(set(got.values())) == len(got)


def test_equal_values_stay_linked_and_the_rest_stays(docs_of):
    text = "Call (212) 555-1212 or a.b@c.de; card 4111 1111 1111 1111.\nNot valid: 4111111111111112, 2021-02-30, 300.1.1.1, version 1.2.3"
    rows = [(1, text), (2, "again a.b@c.de and 4111111111111111 twice 4111111111111111"), (3, None), (4, ""), (5, "clean text 42"), (1, text), (None, "a.b@c.de")]
    got = D.pseudonymised(docs_of(rows), "k")
    assert got.columns == docs_of(rows).columns
    out = [(r.doc_id, r.text) for r in got.collect()]
    by = dict(out)
    assert by[3] is None and by[4] == "" and by[5] == "clean text 42" and out.count((1, by[1])) == 2
    assert by[1].endswith("Not valid: 4111111111111112, 2021-02-30, 300.1.1.1, version 1.2.3")
    assert "555-1212" not in by[1] and "a.b@c.de" not in by[1]
    mail = by[None]
    card = re.search(r"and (\d{16}) twice (\d{16})", by[2])
    assert mail in by[1] and mail in by[2] and card[1] == card[2]
    assert re.sub(" ", "", re.search(r"card ([\d ]{19})", by[1])[1]) == card[1]


def test_report_counts_against_brute_force(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in D.report(docs, "k").collect()}
    for r in docs.collect():
        cards = [c for c in re.findall(D.CARD, r.text or "") if luhn(c)]
        assert got[r.doc_id].n_card == len(cards)
        assert got[r.doc_id].n_mail == len(re.findall(D.MAIL, r.text or ""))
        for value in cards:
            assert value not in got[r.doc_id].text
        if not any(got[r.doc_id][f"n_{k}"] for k in D.KINDS):
            assert got[r.doc_id].text == r.text


def test_long_text_empty_table_and_plan(docs_of, capsys):
    long = "word@" * 20_000 + "9" * 50_000 + "x" * 50_000
    assert len(D.pseudonymised(docs_of([(1, long)]), "k").first().text) == len(long)
    assert D.pseudonymised(docs_of([]), "k").count() == 0
    D.pseudonymised(docs_of([(1, "x")]), "k").explain()
    assert not re.search("Python|Pandas|Arrow|Exchange", capsys.readouterr().out)


def test_mail_before_a_full_stop_keeps_its_link(docs_of):
    got = D.pseudonymised(docs_of([(1, "a.b@c.com"), (2, "Write to a.b@c.com. Or a.b@c.com, then.")]), "k")
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[1] != "a.b@c.com" and by[2] == f"Write to {by[1]}. Or {by[1]}, then."


def test_phones_of_every_code_within_their_format(docs_of):
    rng = random.Random(12)
    some = sorted({f"+1 ({rng.choice([0, 17, 100, 199, 200, 555, 999]):03d}) {rng.choice([0, 55, 199, 200, 555]):03d}-{rng.randint(0, 9999):04d}" for _ in range(300)})
    got = values(docs_of(list(enumerate([*some, "017-555-7713", "017 155.7713"]))))
    code = lambda s: [x < "200" for x in (re.sub(r"\D", "", s)[-10:-7], re.sub(r"\D", "", s)[-7:-4])]
    for v, p in got.items():
        assert re.sub(r"\d", "9", p) == re.sub(r"\d", "9", v) and code(p) == code(v)
    assert len(set(got.values())) == len(got) and sum(v == p for v, p in got.items()) == 0
    text = D.pseudonymised(docs_of([(1, "call +1 (017) 555-7713.")]), "k").first().text
    assert re.fullmatch(r"call \+1 \([01]\d\d\) [2-9]\d\d-\d{4}\.", text) and "(017) 555-7713" not in text


def test_values_beside_other_numbers_against_brute_force(docs_of):
    beside = ["4111 1111 1111 1111 12/27", "4111111111111111 123", "5 4111-1111-1111-1111", "1234 4111 1111 1111 1111 9", "4111 1111 1111 1111 5500 0000 0000 0004", "77 3782-822463-10005 31/12/1999", "1 4222 222 222 222 7"]
    others = {"94107 123-45-6789": "123-45-6789", "12345 2024-01-15": "2024-01-15", "99 212-555-1212 12345": "212-555-1212", "4111 1111 1111 1111 2024-01-15": "2024-01-15"}
    rng = random.Random(13)
    loose = ["".join(rng.choice("0123456789") + rng.choice(["", "", "", " ", "-"]) for _ in range(rng.randint(13, 40))) + "0" for _ in range(150)]
    texts = [*beside, *others, *loose]
    got = {r.doc_id: r for r in D.report(docs_of([(i, f"x {t} y") for i, t in enumerate(texts)]), "k").collect()}

    def valid_runs(t):
        """Every start and length, at the bounds of groups."""
        for a in range(len(t)):
            for b in range(a + 13, len(t) + 1):
                d = re.sub("[ -]", "", t[a:b])
                if not t[a:b][0].isdigit() or not t[a:b][-1].isdigit() or not d.isdigit() or re.search("[ -]{2}", t[a:b]) or (a and t[a - 1].isdigit()) or t[b:b + 1].isdigit():
                    continue
                if 13 <= len(d) <= 19 and luhn(d):
                    yield a, b

    shape = lambda s: re.sub(r"\d", "9", s)
    for i, t in enumerate(texts):
        new = got[i].text[2:-2]
        assert shape(new) == shape(t)
        if t in others:
            assert others[t] not in new
            continue
        if any(got[i][f"n_{k}"] for k in D.KINDS if k != "card") and t in loose:
            continue
        runs = list(valid_runs(t))
        assert (got[i].n_card > 0) == bool(runs), t
        for a, b in runs:  # none is left whole in clear
            assert new[a:b] != t[a:b], t
    assert got[4].n_card == 2 and got[5].n_date == 1 and all(got[i].n_card == 1 for i in (0, 1, 2, 3))
    assert got[0].text.endswith(" 12/27 y") and got[3].text.startswith("x 1234 ") and got[3].text.endswith(" 9 y")
    one = {got[0].text[2:21], got[2].text[4:23].replace("-", " "), got[3].text[7:26], got[4].text[2:21]}
    assert len(one) == 1


def test_long_rows_of_numbers(docs_of):
    rows = " ".join(map(str, range(20_000)))
    text = D.pseudonymised(docs_of([(1, rows + " 4111 1111 1111 1111")]), "k").first().text
    assert len(text) == len(rows) + 20 and not text.endswith("4111 1111 1111 1111")
