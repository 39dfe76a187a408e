import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codesim.operators import linediff as D


def table(a, b):
    """The textbook table of longest common subsequences."""
    l = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]  # noqa: E741
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            l[i + 1][j + 1] = l[i][j] + 1 if x == y else max(l[i][j + 1], l[i + 1][j])
    return l


def check(a, b):
    found = list(D.runs(a, b))
    i = j = equal = 0
    for kind, x, y, n in found:
        assert (x, y) == (i, j) and n > 0
        if kind == "equal":
            assert a[x:x + n] == b[y:y + n]
            equal += n
        i += n if kind != "added" else 0
        j += n if kind != "removed" else 0
    assert (i, j) == (len(a), len(b))
    assert all(p[0] != q[0] for p, q in zip(found, found[1:]))  # no run could be joined with the next
    assert equal == table(a, b)[-1][-1]
    return found


LINES = st.lists(st.integers(0, 5), max_size=30)


@given(LINES, LINES)
@settings(max_examples=400, deadline=None)
def test_runs_follow_a_longest_common_subsequence(a, b):
    check(a, b)


@given(LINES, LINES)
@settings(max_examples=200, deadline=None)
def test_lengths_equal_the_table(a, b):
    assert D.lcs_lengths(a, b).tolist() == table(a, b)[-1]


@pytest.mark.parametrize("word", [1, 3, 64])
def test_blocks_carry_over(monkeypatch, word):
    monkeypatch.setattr(D, "WORD", word)
    rng = random.Random(word)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert D.lcs_lengths(a, b).tolist() == table(a, b)[-1]
        check(a, b)


def test_known_runs():
    assert list(D.runs([1, 2, 3, 4], [1, 3, 4, 5])) == [("equal", 0, 0, 1), ("removed", 1, 1, 1), ("equal", 2, 1, 2), ("added", 4, 3, 1)]
    assert list(D.runs([], [])) == [] and list(D.runs([], [7])) == [("added", 0, 0, 1)] and list(D.runs([7], [])) == [("removed", 0, 0, 1)]
    assert list(D.runs([1], [2])) == [("removed", 0, 0, 1), ("added", 1, 0, 1)]


def test_long_files_in_bounded_memory():
    """Two files of 20,000 lines, a third of them changed throughout."""
    import tracemalloc

    rng = random.Random(1)
    a = [rng.getrandbits(60) for _ in range(20_000)]
    b = [x if rng.random() < 0.66 else rng.getrandbits(60) for x in a]
    tracemalloc.start()
    found = list(D.runs(a, b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for k, *_, n in found if k == "equal") == sum(x == y for x, y in zip(a, b))
    assert peak < 40 << 20


@pytest.fixture(scope="module")
def case(spark):
    texts = {(1, "x.py"): "a\nb\nc\nd", (2, "x.py"): "a\nc\nd\ne\n", (3, "y.py"): "", (4, "z.py"): None, (5, "w.py"): "q\r\nq\x0bq", (6, "é.py"): "a\nb\nc\nd"}
    files = spark.createDataFrame([(*k, t) for k, t in texts.items()], "submission_id long, path string, content string")
    pairs = [(1, 2, "x.py", "x.py"), (1, 3, "x.py", "y.py"), (3, 4, "y.py", "z.py"), (2, 5, "x.py", "w.py"), (1, 6, "x.py", "é.py")]
    return files, spark.createDataFrame([(*p, 0.9) for p in pairs], "id_a long, id_b long, path_a string, path_b string, similarity double")


def test_totals_and_view(case):
    files, pairs = case
    runs = D.diff_runs(pairs, files)
    got = {(r.id_a, r.id_b): (r.n_equal, r.n_removed, r.n_added, r.n_runs) for r in D.diff_totals(pairs, runs).collect()}
    assert got == {(1, 2): (3, 1, 1, 4), (1, 3): (0, 4, 0, 1), (3, 4): (0, 0, 0, 0), (2, 5): (0, 4, 3, 2), (1, 6): (4, 0, 0, 1)}
    view = D.side_by_side(runs, files).where("id_a = 1 AND id_b = 2").orderBy("nth", "at").collect()
    assert [(r.kind, r.line_a, r.text_a, r.line_b, r.text_b) for r in view] == [
        ("equal", 1, "a", 1, "a"), ("removed", 2, "b", None, None), ("equal", 3, "c", 2, "c"), ("equal", 4, "d", 3, "d"), ("added", None, None, 4, "e")]


def test_texts_stay_where_they_are_read(case, capsys):
    """Only line keys are joined to the pairs; contents leave the scan as keys."""
    files, pairs = case
    D.diff_runs(pairs, files).explain()
    plan = capsys.readouterr().out
    moved = [x for x in plan.splitlines() if re.search("Exchange|Join|Sort", x)]
    assert len(moved) >= 4 and not any("content" in x or "Cartesian" in x for x in moved)
    assert plan.count("lambdafunction(xxhash64") >= 2  # below the exchanges of both sides
