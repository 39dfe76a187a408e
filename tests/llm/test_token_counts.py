import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from codesim.llm import token_counts as C


def greedy(word: bytes, pieces: set[bytes]) -> int:
    n = at = 0
    most = max(map(len, pieces))
    while at < len(word):
        k = next(k for k in range(min(most, len(word) - at), 0, -1) if word[at:at + k] in pieces)
        at, n = at + k, n + 1
    return n


@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=6), max_size=12), st.text(alphabet="abcd", max_size=40))
@settings(max_examples=300, deadline=None)
def test_automaton_equals_longest_match(vocabulary, word):
    pieces = {v.encode() for v in vocabulary}
    assert C.Automaton(pieces).count(word.encode()) == greedy(word.encode(), pieces | {bytes([i]) for i in range(256)})


def test_documents_equal_brute_force(docs_of):
    pieces = set(C.vocabulary())
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "The house, ünïcode 漢字 and \U0001f600 \x00"), (5, "z" * 30_000), (6, "the " * 20_000), (None, "no id"), (4, "again"), (4, "again")]
    rows += [(10 + i, " ".join("".join(rng.choices("etaoinABC.é", k=rng.randint(1, 14))) for _ in range(60))) for i in range(20)]
    got = sorted(((r.doc_id, r.n_words, r.n_bytes, r.n_tokens) for r in C.token_counts(docs_of(rows), memo=50).collect()), key=str)
    want = []
    for d, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        want.append((d, len(words), len((t or "").encode()), sum(greedy(C.MARK + w, pieces) for w in words)))
    assert got == sorted(want, key=str)
    assert C.token_counts(docs_of([])).count() == 0
