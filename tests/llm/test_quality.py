import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from codesim.llm import quality as Q


def brute_counts(text):
    words = Q.re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    twice = Counter(grams)
    hit = {j for i, g in enumerate(grams) if twice[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if Q.re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)]


TEXTS = ["", " \n\t", "a", "Ünïcode wörds   x y # * $\n\n|<>&%", "one two three four five six seven eight " * 4, "x " * 5000, "a b\na b\n \n \nc\nc", "w" * 100_000]


@pytest.mark.parametrize("text", TEXTS + [" ".join(random.Random(i).choices("abc", k=60)) for i in range(20)])
def test_counts_equal_brute_force(text):
    assert Q.statistics(text.encode())[:5] == brute_counts(text)


def test_chi2_against_known_points():
    assert Q.chi2_quantile(0.95, 1) == pytest.approx(3.841458820694124, abs=1e-6)
    assert Q.chi2_quantile(0.975, 8) == pytest.approx(17.534546, abs=1e-4)


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(n))


def test_outliers_go_and_clean_documents_stay(docs_of):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(25, 400)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None])) for i in range(900)]
    bad = [(1000 + i, prose(rng, 60).replace(" ", "#$ "), "en", "a") for i in range(30)] + [(2000 + i, prose(rng, 60).upper().replace(" ", "!! "), "de", "b") for i in range(10)]
    copies = [(3000 + i, rows[0][1], *rows[0][2:]) for i in range(600)]
    short = [(4000, "too short"), (4001, None), (4002, "")]
    got = {r.doc_id: r for r in Q.verdicts(docs_of(rows + bad + copies + short)).collect()}
    assert len(got) == len(rows + bad + copies + short)
    assert all(got[r[0]].kept for r in rows + copies)
    assert not any(got[r[0]].kept or got[r[0]].base_failed for r in bad)
    assert all(got[r[0]].base_failed and not got[r[0]].kept for r in short)


def test_mcd_recovers_the_bulk(spark):
    rng = np.random.default_rng(5)
    scale = np.array(Q.FLOORS) * 3
    bulk = rng.normal(size=(4000, Q.P)) * scale
    odd = rng.normal(size=(900, Q.P)) * scale * 0.2 + scale * 9
    rows = [("g", *map(float, x)) for x in np.concatenate([bulk, odd])]
    vectors = spark.createDataFrame(rows, ["gid", *Q.FEATURES])
    fit = Q.mcd(vectors).first()
    assert np.abs(np.array(fit.mu) / scale).max() < 0.15
    spread = np.sqrt(np.diag(np.linalg.inv(np.array(fit.prec).reshape(Q.P, Q.P)))) / scale
    assert (0.85 < spread).all() and (spread < 1.15).all()


def test_empty_table_repeats_and_stage(docs_of):
    assert Q.verdicts(docs_of([])).count() == 0
    assert Q.keep(docs_of([])).count() == 0
    rows = [(1, prose(random.Random(2), 50))] * 2 + [(None, prose(random.Random(3), 50)), (2, None)]
    kept = Q.keep(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]


def test_every_statistic_rejects_alone(docs_of):
    """One document for each statistic that differs from its group in that one only, next to a clean one."""
    rng = random.Random(31)
    lines = lambda n: "\n".join(prose(rng, 8) for _ in range(n))
    rows = [(i, lines(12), "en", "a") for i in range(400)]
    words = prose(rng, 96).split()
    one = {
        "letters": " ".join(w * 6 for w in words),
        "symbols": " ".join(f"{w}#$%" for w in words),
        "capitals": " ".join(words).upper(),
        "marks": " ".join(f"{w}!!" for w in words),
        "digits": " ".join("".join(rng.choices("0123456789", k=len(w))) for w in words),
        # repeated lines of one word, never eight words that repeat
        "lines": "\n".join(x for _ in range(40) for x in ("q", "q", "q", "w", "w", "w", prose(rng, 9))),
        "stutter": " ".join(f"{w} {w}" for w in words),
    }
    odd = [(1000 + i, t, "en", "a") for i, t in enumerate(one.values())] + [(2000, lines(12), "en", "a")]
    got = {r.doc_id: r for r in Q.verdicts(docs_of(rows + odd)).collect()}
    for i, name in enumerate(one):
        assert not got[1000 + i].base_failed and not got[1000 + i].kept, (name, got[1000 + i])
    assert got[2000].kept and all(got[r[0]].kept for r in rows)
    # repeated words have their own limit
    half = " ".join(words[:30]) + " " + " ".join(words[:30]) + " " + " ".join(words)
    r = Q.verdicts(docs_of([(1, half, "en", "a")])).first()
    assert r.base_failed and not r.kept
    assert all((math.pi / 2 / f) ** 2 > Q.chi2_quantile(1 - 1e-6, Q.P) for f in Q.FLOORS[1:6] + Q.FLOORS[7:])


def exact_mcd(x, share, cutoff):
    """Which rows of ``x`` the minimum-covariance-determinant rule keeps, by trying every subset."""
    floors = np.array(Q.FLOORS)

    def estimate(rows, factor):
        cov = np.cov(rows.T, bias=True) * factor / np.outer(floors, floors)
        value, vector = np.linalg.eigh(cov)
        value = np.maximum(value, 1.0)
        return rows.mean(0), (vector / value) @ vector.T / np.outer(floors, floors), np.log(value).sum()

    def far(mu, inverse):
        return np.einsum("ij,jk,ik->i", x - mu, inverse, x - mu)

    h = math.ceil(share * len(x))
    best = min((estimate(x[list(c)], Q.consistency(share)) for c in itertools.combinations(range(len(x)), h)), key=lambda e: e[2])
    mu, inverse, _ = estimate(x[far(*best[:2]) <= Q.chi2_quantile(0.975, Q.P)], Q.consistency(0.975))
    return far(mu, inverse) <= cutoff


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_kept_equals_the_exact_estimate(spark, docs_of, seed):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(120, 200)) for _ in range(14)]
    texts += [prose(rng, 150).replace(" ", " 12345 "), prose(rng, 150).replace(" ", "!? "), prose(rng, 150).upper()]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in Q.verdicts(docs_of(rows), least=10).collect()}
    x = np.array([Q.statistics(t.encode())[5:] for t in texts])
    want = exact_mcd(x, 0.75, Q.chi2_quantile(1 - 1e-6, Q.P))
    assert [got[i].kept for i in range(len(texts))] == want.tolist() and 13 < want.sum() < 17
