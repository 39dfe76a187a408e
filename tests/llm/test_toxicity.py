import random

import numpy as np
import pytest

from codesim.llm import toxicity as X


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(600)]
    stems = ["zorgu", "wextra"]
    docs, labels, bad = [], [], {}
    for i in range(1500):
        sentences = [" ".join(rng.choices(words, k=rng.randint(4, 12))) for _ in range(rng.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(stems) + rng.choice("xyzuvw") + rng.choice("klm")
            bad[i] = at
        docs.append((i, ". ".join(sentences)))
        labels.append((i, 1, int(toxic)))
    return docs, labels, bad


def test_held_out_accuracy_and_spans(spark, docs_of, case):
    docs, labels, bad = case
    got = X.toxicity(docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    held = [r for r in got if r.held_out]
    assert 350 < len(held) < 650
    assert sum(r.predicted == (r.doc_id in bad) for r in held) >= 0.97 * len(held)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.predicted and r.doc_id in bad:
            start = sum(len(s) + 2 for s in text[r.doc_id].split(". ")[:bad[r.doc_id]])
            assert any(o.start - 1 <= start <= o.end for o in r.offences)


def test_scores_come_from_texts_alone(spark, docs_of):
    model = X.Model(-2.0, np.zeros(X.SIZE, np.float32))
    rows = [(1, None), (2, ""), (3, "..!\n123"), (4, "one. two"), (None, "one. two"), (4, "one. two"), (5, "word " * 50_000)]
    got = sorted(((r.doc_id, round(r.score, 9)) for r in X.scored(docs_of(rows), model).collect()), key=str)
    p = 1 / (1 + np.exp(2.0))
    two, one = round(1 - (1 - p) ** 2, 9), round(p, 9)
    assert got == sorted([(1, 0.0), (2, 0.0), (3, 0.0), (4, two), (4, two), (None, two), (5, one)], key=str)


def test_no_or_one_sided_labels(spark, docs_of):
    rows = docs_of([(i, "some words") for i in range(9)])
    none = spark.createDataFrame([(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in X.toxicity(rows, none).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1, 1) for i in range(9)], "doc_id long, quality int, toxic int")
    assert {r.score for r in X.toxicity(rows, ones).collect()} == {1.0}
    assert X.toxicity(docs_of([]), none).count() == 0


def test_sample_holds_each_id_once_and_few_bytes(spark, docs_of):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = docs_of([(i, f"text number {i}") for i in range(40)] + [(i, f"text repeated {k}") for i in range(10) for k in range(30)])
    texts, y, _ = X.labelled(docs, labels, 3, 4000)
    from zlib import crc32

    assert len(texts) == len(y) == sum(crc32(str(i).encode()) % 3 != 1 for i in range(40))
    texts, y, share = X.labelled(docs, labels, 3, 4000, most=100)
    assert {0, 1} == set(y.tolist()) and all(sum(len(t) for t, c in zip(texts, y) if c == k) <= 100 for k in (0, 1))
