import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from codesim.llm import simhash as S


def brute_print(text, shingle=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """prints: {doc_id: fingerprint} -> {doc_id: smallest reachable id}."""
    top = {d: d for d in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: find(d) for d in ids}


TEXTS = [None, "", " \n ", "One", "one two", "Ä Ö Ü ä ö", "a b c", "the same words here and there " * 60, "x " * 3000, "y" * 50_000]


def test_fingerprints_equal_brute_force(docs_of):
    texts = TEXTS + [" ".join(random.Random(i).choices("abcdefgh", k=700)) for i in range(5)]
    got = {r.doc_id: r.fp % 2**64 for r in S.fingerprints(docs_of(list(enumerate(texts)))).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}


@given(st.lists(st.integers(0, 2**12 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_tree_search_misses_nothing(keys, radius):
    import numpy as np

    found = {(keys[q], keys[n]) for near, n in S.BKTree(keys).links(np.array(keys, np.uint64), radius) for q in near.tolist()}
    assert found == {(a, b) for a in keys for b in keys if (a ^ b).bit_count() <= radius}


@pytest.mark.parametrize("tile,blocks", [(4, None), (2048, None), (4, 5), (2048, 6)])
def test_components_equal_brute_force(spark, tile, blocks):
    rng = random.Random(7)
    prints = []
    for _ in range(12):  # chains, dense families with equal blocks, and strangers
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            prints.append(x)
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distinct = spark.createDataFrame([(signed(p),) for p in set(prints)], "fp long")
    roots = {r.u: r.root for r in S.components(S.links(distinct, tile=tile, blocks=blocks)).collect()}
    group = lambda p: roots.get(signed(p), signed(p))
    want = brute_components(dict(enumerate(sorted(set(prints)))))
    order = sorted(set(prints))
    for i, p in enumerate(order):
        for j, q in enumerate(order[:i]):
            assert (group(p) == group(q)) == (want[i] == want[j])


def test_near_duplicates_and_stage(docs_of):
    rng = random.Random(3)
    base = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(400)) for _ in range(6)]
    rows = []
    for i, t in enumerate(base):
        rows += [(10 * i + 3, t), (10 * i + 1, t), (10 * i + 2, t + " tail"), (10 * i + 1, t)]
    rows += [(90, None), (91, ""), (92, " "), (None, base[0]), (None, "all alone here with words")]
    got = S.near_duplicates(docs_of(rows)).collect()
    prints = {r[0]: brute_print(r[1]) for r in rows if r[0] is not None}
    want = brute_components(prints)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted((r[0], want[r[0]]) for r in rows if r[0] is not None)
    kept = S.deduplicate(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, sorted(set(want.values()))), "None"])


def test_blocks_grow_with_the_fingerprints():
    """Links within three bits agree in a choice of blocks, and copies a fingerprint stay few however many there are."""
    rng = random.Random(17)
    for blocks in range(4, 9):
        chosen = S.masks(blocks, 3)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randint(0, 3)):
                y ^= 1 << b
            assert any(x & m == y & m for m in chosen)
    assert [S.enough_blocks(n, 3, 2048) for n in (0, 10**6, 10**8, 10**9, 10**10, 10**11)] == [4, 4, 4, 5, 5, 6]
    assert len(S.masks(5, 3)) == 10


def test_empty_table(docs_of):
    assert S.near_duplicates(docs_of([])).count() == 0
    assert S.deduplicate(docs_of([])).count() == 0
