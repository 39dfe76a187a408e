"""MinHash bands and the cosine index against brute force."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from codesim.operators import fingerprint, lsh, similarity


def test_bands_keep_the_promised_recall():
    for tau in (0.3, 0.5, 0.7, 0.9):
        r = lsh.rows_for(tau)
        assert 1 - (1 - tau**r) ** (128 // r) >= 0.995
        assert r == 128 or 1 - (1 - tau ** (r + 1)) ** (128 // (r + 1)) < 0.995
    assert lsh.rows_for(1.0) == 128 and lsh.rows_for(0.001) == 1


def test_minima_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for size, shared in ((40, 30), (9000, 5000)):
        keys = rng.integers(0, 2**63, 2 * size - shared, np.uint64)
        a, b = lsh.minima(keys[:size]), lsh.minima(keys[size - shared:])
        assert abs((a == b).mean() - shared / (2 * size - shared)) < 0.15
        assert (a == lsh.minima(keys[:size][::-1])).all()


@pytest.fixture(scope="module")
def corpus(spark):
    """Families of near copies with many sizes, copies of one class and a crowd that shares most of its shingles."""
    rng = random.Random(2)
    sets, files = {}, []
    for f in range(40):
        base = [rng.getrandbits(62) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 5)):
            keep = rng.uniform(0.6, 1.0)
            sets[len(sets)] = frozenset(x for x in base if rng.random() < keep) | {rng.getrandbits(62) for _ in range(rng.randint(0, 6))}
    crowd = [rng.getrandbits(62) for _ in range(50)]
    for _ in range(30):
        sets[len(sets)] = frozenset(crowd) | {rng.getrandbits(62)}
    for c, keys in sets.items():
        for copy in range(3 if c % 17 == 0 else 1):
            files.append((rng.randrange(12), f"p{len(files)}", "py", c, keys))
    reps = spark.createDataFrame([(c * 10**15, c, len(k), sum(x[3] == c for x in files), sorted(k)) for c, k in sets.items()], "cls_hi long, cls_lo long, n long, members long, keys array<bigint>")
    rows = spark.createDataFrame([(s, p, e, c * 10**15, c, len(k)) for s, p, e, c, k in files], "submission_id long, path string, ext string, cls_hi long, cls_lo long, n_shingles long")
    return reps, rows, files


def exact(files, tau):
    out = {}
    for x, y in combinations(files, 2):
        (s, p, _, _, a), (t, q, _, _, b) = sorted((x, y), key=lambda f: f[0])
        if s != t and a and b and len(a & b) / len(a | b) >= tau:
            out[s, p, t, q] = len(a & b) / len(a | b)
    return out


@pytest.mark.parametrize("tau", [0.5, 0.8])
@pytest.mark.parametrize("limit", [2, 2000])
def test_recall_and_exact_rows(corpus, tau, limit):
    reps, rows, files = corpus
    want = exact(files, tau)
    got = {(r.id_a, r.path_a, r.id_b, r.path_b): r.similarity for r in lsh.pairs_at_least(reps, rows, tau, limit=limit).collect()}
    assert all(math.isclose(want[k], v) for k, v in got.items())  # nothing but true pairs
    assert len(want) > 300 and len(got) >= 0.98 * len(want)
    plain = {(r.id_a, r.path_a, r.id_b, r.path_b) for r in similarity.pairs_at_least(reps, rows, tau, limit).collect()}
    assert plain == set(want)


def test_empty_classes(spark, corpus):
    reps, rows, _ = corpus
    assert lsh.pairs_at_least(reps.limit(0), rows.limit(0), 0.5).count() == 0
    assert lsh.signatures(reps.selectExpr("cls_hi", "cls_lo", "n", "members", "cast(array() as array<bigint>) AS keys")).count() == 0
    with pytest.raises(ValueError):
        lsh.pairs_at_least(reps, rows, 0.0)


@pytest.mark.parametrize("tau", [0.3, 0.6, 0.9])
def test_cosine_pairs_equal_brute_force(spark, tau):
    rng = random.Random(3)
    odds = [1 / (i + 1) for i in range(120)]
    vectors = {}
    for i in range(60):
        like = vectors.get(i - 1, Counter()) if i % 3 else Counter()
        vectors[i] = like + Counter(rng.choices([f"t{k}" for k in range(120)], odds, k=rng.randint(1, 60)))
    df = Counter(t for v in vectors.values() for t in v)
    weight = {i: {t: c * (math.log(61 / (1 + df[t])) + 1) for t, c in v.items()} for i, v in vectors.items()}
    rows = spark.createDataFrame([(i, t, w, df[t]) for i, v in weight.items() for t, w in v.items()], "submission_id long, token string, w double, df long")
    norm = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in weight.items()}
    want = {}
    for a, b in combinations(weight, 2):
        c = sum(w * weight[b].get(t, 0) for t, w in weight[a].items()) / norm[a] / norm[b]
        if c >= tau:
            want[a, b] = c
    for limit in (3, 2000):
        got = {(r.id_a, r.id_b): r.cosine for r in fingerprint.cosine_at_least(rows, tau, limit).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert want
    if tau == 0.9:  # few pairs are formed
        assert fingerprint.cosine_candidates(rows, tau).count() < 0.6 * 60 * 59 / 2


def test_weights_meet_by_token_and_no_pair_token_is_shuffled(spark):
    import contextlib
    import io
    import re

    rows = spark.createDataFrame([(i, f"t{k}", 1.0 + i + k, 5) for i in range(6) for k in range(40)], "submission_id long, token string, w double, df long")
    pairs = spark.createDataFrame([(0, 1), (2, 5), (0, 1)], "id_a long, id_b long")
    out = io.StringIO()
    got = fingerprint.cosines(rows, pairs, few=True)
    with contextlib.redirect_stdout(out):
        got.explain("formatted")
    exchanged = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", out.getvalue(), re.S)
    assert exchanged and not [c for c in exchanged if re.search(r"\bid_a#", c) and re.search(r"\b(token|w_a|w_1)#", c)]

    def cosine(a, b, times):
        dot = sum((1 + a + k) * (1 + b + k) for k in range(40))
        return times * dot / math.sqrt(sum((1 + a + k) ** 2 for k in range(40)) * sum((1 + b + k) ** 2 for k in range(40)))

    # a pair that is given twice counts twice, in each of its rows
    want = sorted([(0, 1, cosine(0, 1, 2))] * 2 + [(2, 5, cosine(2, 5, 1))])
    assert sorted(map(tuple, got.collect())) == [pytest.approx(x) for x in want]
    assert sorted(map(tuple, fingerprint.cosines(rows, pairs).collect())) == [pytest.approx(x) for x in want]
