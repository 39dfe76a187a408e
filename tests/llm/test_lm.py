import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codesim.llm import lm


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1


@pytest.mark.parametrize("frequent", [3, 200_000])
def test_exact_columns_and_model(docs_of, frequent):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["Über", "THE", "the"]
    odds = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, odds, k=rng.randint(0, 120)))) for i in range(300)]
    rows += [(1000 + i, "the quick brown fox jumps over it " * 3) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, "unseen only here"), (None, "no id"), (7, rows[7][1]), (7, rows[7][1]), (2003, "w1 " * 30_000)]
    got = lm.scores(docs_of(rows), frequent=frequent, per_segment=4000, weight=0.15).collect()
    assert len(got) == len(rows)
    c, pairs = Counter(), Counter()
    for d, t in rows:
        if not held(d):
            x = tokens(t)
            c.update(x)
            pairs.update(zip(["<s>", *x], x))
    n, v, docs = sum(c.values()), len(c), c[None]
    base = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))

    def model(t):
        out, x = 0.0, tokens(t)
        for a, b in zip(["<s>", *x], x):
            ca = docs if a == "<s>" else c[a]
            out += math.log10(0.15 * min(1, pairs[a, b] / ca if ca else 0) + 0.85 * (c[b] + 0.5) / (n + 0.5 * (v + 1)))
        return out

    want = Counter((d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base(t), 6)) for d, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    exact = {d: model(t) for d, t in rows}
    for r in got:  # quantised counts move a token's probability a little, the odd false positive by more
        assert abs(r.score - exact[r.doc_id]) <= 0.1 * r.n_tokens + 2
    assert abs(sum(r.score - exact[r.doc_id] for r in got)) <= 0.03 * sum(r.n_tokens for r in got)
    assert all(r.score < 0 for r in got)
    copies = [r for r in got if r.doc_id is not None and 1000 <= r.doc_id < 1060 and r.held_out]
    assert copies and all(r.score > r.base_score for r in copies)


def test_filter_returns_levels():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 20_000, np.uint64)
    n = rng.integers(1, 500, 20_000)
    batch = lm._parcels(h, n, 2, 3).to_pydict()
    segments = [(s, lm._segment([k], [a], [b], 1.5)) for s, k, a, b in zip(batch["seg"], batch["kind"], batch["hashes"], batch["counts"])]
    grams = lm.LogFrequencyFilter(segments, 3, sum(len(d) for _, d in segments))
    want, got = lm.levels(n, 1.5), grams.levels(h)
    assert (got >= want).all() and (got == want).mean() > 0.96  # a Bloom filter can only overstate
    assert (np.abs(lm.level_means(1.5)[want] - n) <= n / 2).all()
    most, least = rng.integers(0, 12, 20_000), rng.integers(0, want + 1)
    assert (grams.levels(h, most) == np.minimum(got, most)).all()
    assert (grams.levels(h, None, least) == got).all() and (grams.levels(h, most, least) == np.minimum(got, most)).all()
    strange = grams.levels(rng.integers(0, 2**63, 20_000, np.uint64))
    assert (strange > 0).mean() < 0.03


TEXTS = ["", None, " \t\n\x0b\x0c\r ", "One", " a  B\ta ", "\x1c x \x85 \xa0y\u3000", "É É é", "end " * 3]


def test_tokens_equal_the_regular_expression():
    import pyarrow as pa

    t = lm.Tokens(pa.array(TEXTS, pa.string()))
    names = [*t.distinct, None]
    got, at = [], 0
    for n in t.sizes.tolist():
        got.append([names[i] and names[i].decode() for i in t.ids[at:at + n].tolist()])
        at += n
    assert got == [tokens(x) for x in TEXTS] and at == len(t.ids)
    first, second, place = t.pairs()
    names.append("<s>")
    pairs = [(names[a], names[b]) for a, b in zip(first.tolist(), second.tolist())]
    assert len(set(pairs)) == len(pairs)
    assert [pairs[i] for i in place.tolist()] == [(a and a.encode() if a != "<s>" else a, b and b.encode()) for x in TEXTS for a, b in zip(["<s>", *tokens(x)], tokens(x))]


def test_chunks_are_whole(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm, "CHUNK", 10)
    texts = ["abc", "", None, "x" * 50, "abcdef", "abcdefg", "z"]
    got = [(a, c.to_pylist()) for a, c in lm.chunks(pa.array(texts, pa.string()))]
    assert [x for _, c in got for x in c] == texts and [a for a, _ in got] == list(np.cumsum([0, *(len(c) for _, c in got)]))[:-1]
    assert len(got) > 2 and list(lm.chunks(pa.array([], pa.string()))) == []


def test_weight_is_the_likeliest_with_each_token_left_out(spark, docs_of):
    rng = random.Random(15)

    def text():  # the next word mostly depends on the one before
        out = ["w0"]
        for _ in range(rng.randint(5, 80)):
            out.append(f"w{(int(out[-1][1:]) * 7 + rng.choice([1, 2, 3])) % 300}" if rng.random() < 0.4 else f"w{rng.randrange(300)}")
        return " ".join(out)

    rows = [(i, text()) for i in range(400)]
    c, pairs = Counter(), Counter()
    train = [tokens(t) for d, t in rows if not held(d)]
    for x in train:
        c.update(x)
        pairs.update(zip(["<s>", *x], x))
    n, v, docs = sum(c.values()), len(c), c[None]

    def likelihood(weight):
        total = 0.0
        for (a, b), k in pairs.items():
            context = docs if a == "<s>" else c[a]
            total += k * math.log10(weight * (k - 1) / max(1, context - 1) + (1 - weight) * (c[b] - 1 + 0.5) / (n - 1 + 0.5 * (v + 1)))
        return total

    best = max(lm.WEIGHTS, key=likelihood)
    assert lm.WEIGHTS[0] < best < lm.WEIGHTS[-1]
    free, fixed = (sorted((r.doc_id, round(r.score, 9)) for r in lm.scores(docs_of(rows), weight=w).collect()) for w in (None, best))
    assert free == fixed


def test_empty_table_and_no_training(docs_of):
    assert lm.scores(docs_of([])).count() == 0
    only = next(i for i in range(100) if held(i))
    r = lm.scores(docs_of([(only, "some words")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0.0)


def test_pairs_seen_once_count_at_every_size(docs_of, spark, tmp_path):
    from codesim.llm.queries import QUERIES

    rng = random.Random(10)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(80)], k=rng.randint(0, 60)))) for i in range(200)]
    out = [i for i in range(1000, 1100) if held(i)][:2]
    # "solo" and "act" stand together once in the training part, "act" and "solo" never
    rows += [(next(i for i in range(900, 999) if not held(i)), "solo act then act w1 solo"), (out[0], "solo act"), (out[1], "act solo"), (None, None), (3, "")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_tokens, round(r.score, 9))
    got = sorted(map(key, QUERIES["op5_lm_scoring"](spark, str(tmp_path)).collect()))
    by = {k[1]: k[3] for k in got}
    assert by[out[0]] > by[out[1]]
    whole, parts = (sorted(map(key, lm.scores(docs_of(rows), per_segment=500, max_bytes=m).collect())) for m in (128 << 20, 0))
    assert len(whole) == len(rows) and whole == parts


def test_a_segment_is_probed_at_once(monkeypatch):
    """As many rows as chunks ask a segment: it is probed once, not row by row, and each row gets its own levels."""
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**48, 3000, np.uint64)
    batch = lm._parcels(h, rng.integers(1, 90, 3000), 2, 1).to_pydict()
    one = lm.LogFrequencyFilter([(0, lm._segment(batch["kind"], batch["hashes"], batch["counts"], 1.5))], 1, 1 << 20)
    rows = [rng.choice(np.append(h, rng.integers(0, 2**48, 50, np.uint64)), n) for n in (0, 7, 1, 0, 900, *[3] * 400)]
    want, calls, real = [one.levels(x).tolist() for x in rows], [], lm.LogFrequencyFilter.levels
    monkeypatch.setattr(lm.LogFrequencyFilter, "levels", lambda self, *a: calls.append(1) or real(self, *a))
    got = lm._answers(one, [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for x in rows])
    assert [list(b) for b in got.to_pylist()] == want and len(calls) == 1
    assert lm._answers(one, []).to_pylist() == [] and lm._answers(one, [b""]).to_pylist() == [b""]
