import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codesim.llm import spelling as S


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, tried one by one."""
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    ns = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(ns[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(ns[w]), n[form[w]] if w in form else None))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    stems = ["".join(rng.choices("abcdeéüÀ×", k=rng.randint(4, 9))) for _ in range(60)] + ["information", "chains", "ab", "Ünder"]
    words = list(stems)
    for w in stems:
        for _ in range(4):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcé") + w[i:], w[:i] + "x" + w[i + 1:]]))
    out = [(i, rng.choice([" ", "\n", "1", "日", "'"]).join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 120)))) for i in range(150)]
    # a chain of forms: each at least twice as frequent as the one before
    out += [(500, "chainsabc " * 3 + "chainsab " * 7 + "chainsa " * 15 + "chains " * 40)]
    return out + [(None, None), (None, "CHAINS Chains"), (501, ""), (502, "information " * 20_000), out[0], out[0]]


@pytest.mark.parametrize("tile,every", [(2048, 97), (3, 5)])
def test_equals_brute_force(spark, docs_of, rows, tile, every):
    got = S.variants(docs_of(rows), every=every, tile=tile)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r) for r in got.collect()]
    want = brute(rows, every)
    assert len(found) == len(want) and set(found) == want
    assert any(r[1] and r[2] != r[1] for r in want) and sum(r[4] for r in want) > 100


def test_counts_sent_early(spark, docs_of, rows, monkeypatch):
    monkeypatch.setattr(S, "HELD", 3)
    assert {tuple(r) for r in S.variants(docs_of(rows)).collect()} == brute(rows)


def test_empty_tables(spark, docs_of):
    assert S.variants(docs_of([])).count() == 0
    assert S.variants(docs_of([(1, None), (2, ""), (3, "words seen only once")])).count() == 0


WORD = st.text(st.sampled_from("abcéÿ"), min_size=1, max_size=7).map(lambda w: w.encode("latin-1"))


@given(WORD, WORD)
@settings(max_examples=400, deadline=None)
def test_one_edit(a, b):
    assert S.one_edit(a, b) == near(a.decode("latin-1"), b.decode("latin-1"))


@given(st.lists(WORD, min_size=1, max_size=25, unique=True), st.lists(WORD, min_size=1, max_size=25, unique=True))
@settings(max_examples=200, deadline=None)
def test_gram_product_keeps_every_near_pair(xs, ys):
    kept = set(S.close(xs, ys))
    assert {(a, b) for a in xs for b in ys if S.one_edit(a, b)} <= kept
    assert all(sum((Counter(a) - Counter(b)).values()) ** 2 <= 4 for a, b in kept)
