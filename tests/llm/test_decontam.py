import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from codesim.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, bench, window=10):
    grams = {}
    for i, t in bench:
        w = WORD.findall(low(t))
        n = min(window, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                grams.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, items = set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    items |= ids
        out.append((d, len(w), len(hit), sorted(items)))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["Élan", "ÄB", "x1"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    bench = [(i, text(rng.randint(3, 30))) for i in range(30)] + [(100, ""), (101, None), (102, "ONE-two, Three"), (103, "one two three"), (None, "w1 w2 w3"), (2000, text(12))]
    docs = []
    for i in range(40):
        t = text(rng.randint(0, 80))
        if i % 3 == 0:
            t += ".\n" + (bench[i % 30][1] or "").upper() + "! " + text(5)
        docs.append((i, t))
    docs += [(50, None), (51, ""), (52, "  ,.;"), (53, "say one two three now"), (54, bench[0][1] + " " + bench[0][1]), (1, docs[1][1]), (1, "other text of the same id"), (None, bench[1][1]), (60, text(20_000) + " " + bench[5][1])]
    return docs, bench


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_equals_brute_force(spark, docs_of, case, bound):
    docs, bench = case
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = D.contamination(docs_of(docs), b, max_broadcast=bound).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=key) == sorted(brute(docs, bench), key=key)


def test_spans_and_documents_go(spark, docs_of):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = docs_of([(1, f"Keep this, {item.upper()}; and that."), (2, "clean text stays as it is"), (3, None), (4, f"- {item}")])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    cut = {r.doc_id: r.text for r in D.remove_spans(docs, bench).collect()}
    assert cut == {1: "Keep this, and that.", 2: "clean text stays as it is", 3: None, 4: "- "}
    left = D.remove_documents(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    r = D.contamination(docs_of([(1, "some words")]), bench).collect()
    assert [(x.n_words, x.n_hit, x["items"]) for x in r] == [(2, 0, [])]
    assert D.contamination(docs_of([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert D.remove_documents(docs_of([(1, "x")]), bench).count() == 1


def test_no_python_on_the_main_path(spark, docs_of, capsys):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    D.remove_documents(docs_of([(1, "x")]), bench).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def test_query_digest(spark, tmp_path, docs_of, case):
    from codesim.llm.queries import QUERIES

    docs, bench = case
    docs_of(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op9_benchmark_decontamination"](spark, str(tmp_path)).where(F.col("doc_id") == 54).first()
    ids = brute([d for d in docs if d[0] == 54], bench)[0][3]
    assert got.items_sha256 == hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest() and got.n_items == len(ids)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_item_without_id_is_a_hit_as_in_the_sql(spark, docs_of, bound):
    bench = spark.createDataFrame([(None, "alpha beta gamma"), (None, "delta epsilon"), (5, "alpha beta gamma"), (6, "zeta eta")], "item_id long, text string")
    docs = docs_of([(1, "so Alpha, beta gamma!"), (2, "and delta epsilon too"), (3, "clean"), (4, "zeta eta")])
    got = {r.doc_id: (r.n_hit, r.n_items, r["items"], [tuple(s) for s in r.spans]) for r in D.contamination(docs, bench, max_broadcast=bound).collect()}
    # n_items as OP9 counts: the null id is one of the distinct ids
    assert got == {1: (3, 2, [5], [(1, 3)]), 2: (2, 1, [], [(1, 2)]), 3: (0, 0, [], []), 4: (2, 1, [6], [(0, 2)])}
    assert [r.doc_id for r in D.remove_documents(docs, bench).collect()] == [3]
