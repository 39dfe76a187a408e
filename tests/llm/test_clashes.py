"""Inputs whose own columns are called like the operators' helper columns."""

import random

import pytest

from codesim.llm import decontam, pii, quality, simhash

NAMES = ["_id", "_key", "_spans", "_parts", "_lead", "n", "of", "text_key", "spans", "parts", "lead", "_of", "key", "root", "fp", "component_id", "kept", "mu", "bin", "at", "row"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(20)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(n))
    rows = [(i, prose(40), "en", "a") for i in range(30)]
    rows += [rows[0], rows[0], (50, rows[0][1], "en", "b"), (60, rows[1][1] + " one two three four five six seven eight nine ten", "en", "a")]
    return spark.createDataFrame([(*r, *[f"own {x}" for x in NAMES]) for r in rows], ["doc_id", "text", "lang", "source", *NAMES])


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")


@pytest.mark.parametrize("step", ["keep", "deduplicate", "remove_documents", "remove_spans", "pseudonymised"])
def test_columns_pass_through(docs, bench, step):
    out = {"keep": lambda: quality.keep(docs), "deduplicate": lambda: simhash.deduplicate(docs), "remove_documents": lambda: decontam.remove_documents(docs, bench), "remove_spans": lambda: decontam.remove_spans(docs, bench), "pseudonymised": lambda: pii.pseudonymised(docs, "k")}[step]()
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[x] == f"own {x}" for r in rows for x in NAMES)
    ids = sorted(r.doc_id for r in rows)
    every = sorted(r.doc_id for r in docs.select("doc_id").collect())
    want = {"deduplicate": [*range(30), 60], "remove_documents": [i for i in every if i != 60]}
    assert ids == want.get(step, every)
