import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codesim.llm import packing as P


def plain_best_fit(lengths, size):
    """Windows' remaining capacities, one piece at a time."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [c for c in left if c >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(size - n)
    return sorted(left)


@given(st.lists(st.integers(1, 32), max_size=120))
@settings(max_examples=150, deadline=None)
def test_batches_pack_like_single_pieces(lengths):
    counts = Counter(lengths)
    windows, ranks = defaultdict(list), defaultdict(set)
    for length, first, n, window, each, offset in P.best_fit_decreasing(counts, 32):
        for r in range(n):
            assert first + r not in ranks[length]
            ranks[length].add(first + r)
            windows[window + r // each].append((offset + r % each * length, length))
    assert {k: len(v) for k, v in ranks.items()} == dict(counts)
    assert all(ranks[k] == set(range(n)) for k, n in counts.items())
    for pieces in windows.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= 32
    assert sorted(32 - sum(n for _, n in p) for p in windows.values()) == plain_best_fit(lengths, 32)
    assert sorted(windows) == list(range(len(windows)))


@given(st.sets(st.integers(1, 2048), max_size=40), st.integers(1, 2048))
def test_segment_tree_finds_the_tightest(open_at, least):
    tree = P.Capacities(2048)
    for c in open_at:
        tree.add(c, 1)
    assert tree.tightest(least) == min((c for c in open_at if c >= least), default=None)


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(P.default_vocabulary())


@given(st.one_of(st.text(max_size=200), st.text(alphabet="ab '\n\t  \u3000é漢1!<|endoftext|>", max_size=80)))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_tokenizer(exact, text):
    with open(P.default_vocabulary(), encoding="utf-8") as f:
        encoder = _encoder(f.read())
    assert encoder.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids


_CACHE = {}


def _encoder(spec):
    return _CACHE.setdefault("e", None) or _CACHE.update(e=P.Encoder(spec)) or _CACHE["e"]


def test_pieces_are_whole_and_gapless(docs_of, exact):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "house", "Ärger", "x\n"], k=rng.randint(0, 900)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "word " * 30_000), (103, "<|endoftext|> a"), (None, "no id"), (5, rows[5][1]), (5, rows[5][1])]
    got = P.packed(docs_of(rows)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, text in rows:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048]), len(ids)) for a in range(0, len(ids), 2048)]
        times = sum(1 for x in rows if x[0] == d)
        assert sorted(pieces[d]) == sorted(want * times)
    for s in sequences.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(r.length for r in got)
    assert len(sequences) <= total / 2048 * 1.2 + 1


def test_empty_table(docs_of):
    assert P.packed(docs_of([])).count() == 0
