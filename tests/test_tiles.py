"""File pairs in tiles against the self-join, and what is shuffled for them."""

import contextlib
import io
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codesim.operators import lsh, tiles
from codesim.operators import similarity as S

COLS = ["id_a", "path_a", "id_b", "path_b", "inter", "ext", "n_a", "n_b"]


@pytest.fixture(scope="module", params=["long", "string"])
def corpus(spark, request):
    """Near copies, classes of many copies, a key that every class holds; numeric and text keys, submissions that repeat paths."""
    rng, sets, files = random.Random(5), [], []
    for _ in range(12):
        base = [rng.getrandbits(62) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 5)):
            sets.append([7, *(x for x in base if rng.random() < 0.8), *(rng.getrandbits(62) for _ in range(rng.randint(0, 4)))])
    sets.append([])
    hi = [rng.randrange(2**60) for _ in sets]
    hi[1] = hi[0]  # told apart by the low part only
    for c, keys in enumerate(sets):
        for copy in range(9 if c % 10 == 0 else rng.randint(1, 2)):
            files.append((rng.randrange(6), f"p{rng.randrange(40)}_{copy}", "py", hi[c], c, len(keys)))
    files = list({(f[0], f[1]): f for f in files}.values())
    kind = "bigint" if request.param == "long" else "string"
    cast = (lambda k: k) if kind == "bigint" else str
    members = [sum(f[4] == c for f in files) for c in range(len(sets))]
    reps = spark.createDataFrame([(hi[c], c, len(k), members[c], [cast(x) for x in k]) for c, k in enumerate(sets) if members[c]],
                                 f"cls_hi long, cls_lo long, n long, members long, keys array<{kind}>")
    rows = spark.createDataFrame(files, "submission_id long, path string, ext string, cls_hi long, cls_lo long, n_shingles long")
    return reps.localCheckpoint(), rows.localCheckpoint()


def _rows(df):
    return sorted(map(tuple, df.select(*COLS).collect()))


def test_slices_and_ranges(monkeypatch):
    monkeypatch.setattr(tiles, "AT_ONCE", 5)
    for count in ([], [0, 0], [3], [9, 1, 0, 2, 2, 7], [1] * 20):
        cuts = tiles._slices(np.array(count, np.int64))
        assert [u for u, _ in cuts][1:] == [v for _, v in cuts][:-1] and (cuts[0][0], cuts[-1][1]) == (0, len(count))
        assert all(sum(count[u:v]) <= 5 + max(count, default=0) for u, v in cuts)
        start = np.arange(len(count), dtype=np.int64) * 100
        assert tiles._ranges(start, np.array(count, np.int64)).tolist() == [100 * k + x for k, c in enumerate(count) for x in range(c)]


@pytest.mark.parametrize("blocks,limit", [(1, 2000), (4, 2)])
def test_tiles_equal_the_self_join(corpus, blocks, limit):
    reps, sets = corpus
    shared = S.shared_sets(reps)
    want = _rows(S.shared_shingle_counts(reps, sets))
    assert len(want) > 500 and want == _rows(S.shared_shingle_counts(reps, sets, limit, shared, blocks=blocks))
    for tau in (0.05, 0.6):
        want = _rows(S.shared_shingle_counts(reps, sets, at_least=tau))
        assert want and want == _rows(S.shared_shingle_counts(reps, sets, limit, shared, tau, blocks))
    pair = [*COLS[:4], "similarity"]
    old, new = (sorted(map(tuple, lsh.pairs_at_least(reps, sets, 0.5, limit=limit, shared=shared, blocks=b).select(*pair).collect())) for b in (0, blocks))
    assert old and old == new


def test_ids_need_not_be_numbers(corpus):
    reps, sets = corpus
    named = sets.withColumn("submission_id", F.concat(F.lit("s"), F.col("submission_id").cast("string")))
    want = _rows(S.shared_shingle_counts(reps, named))
    assert want == _rows(S.shared_shingle_counts(reps, named, shared=S.shared_sets(reps), blocks=2))


def test_no_pair_is_shuffled(corpus):
    reps, sets = corpus
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        tiles.file_pairs(S.shared_sets(reps), S.class_seats(sets, reps), 2000, blocks=2).explain()
    above = out.getvalue().split("FlatMapGroupsInArrow")[0]
    assert "Exchange" not in above and "Join" not in above


def test_blocks_follow_the_keys(corpus, monkeypatch):
    reps, _ = corpus
    least = tiles.number_of_blocks(reps)
    monkeypatch.setattr(tiles, "KEYS_EACH", 1)
    assert tiles.number_of_blocks(reps) > least >= 1 and tiles.number_of_blocks(reps.limit(0)) == least


def test_only_classes_that_can_meet_are_dealt(spark, monkeypatch):
    """Sizes from 8 to 512, half of them with too few shared keys for 0.5: those stay away, and the others meet only blocks of like sizes."""
    rng, sets = random.Random(8), []
    for size in (8, 16, 32, 64, 128, 256, 512):
        base = [rng.getrandbits(62) for _ in range(size)]
        sets += [base, base[:-1] + [rng.getrandbits(62)], [7, *(rng.getrandbits(62) for _ in range(size - 1))], [7, *(rng.getrandbits(62) for _ in range(size - 1))]]
    reps = spark.createDataFrame([(rng.randrange(2**60), c, len(k), 1, k) for c, k in enumerate(sets)], "cls_hi long, cls_lo long, n long, members long, keys array<bigint>").localCheckpoint()
    seats = reps.select(F.col("cls_lo").alias("submission_id"), F.lit("p").alias("path"), F.lit("py").alias("ext"), *S.CLS, F.col("n").alias("n_shingles"), "members")
    shared = S.shared_sets(reps).localCheckpoint()
    dealt = tiles.dealt_rows(shared, seats, 2000, 0.5, 6).select("cls_lo", "n", "b", "i", "j").collect()
    assert {r.cls_lo for r in dealt} == {c for c in range(len(sets)) if c % 4 < 2}
    assert len(dealt) < 14 * 6 * 3 / 4 and {(r.cls_lo, r.b) for r in dealt if r.i == r.j} == {(r.cls_lo, r.b) for r in dealt}
    assert tiles.dealt_rows(shared, seats, 2000, 0.0, 6).count() == 28 * 6
    found = {(r.id_a, r.id_b) for r in tiles.file_pairs(shared, seats, 2000, 0.5, blocks=6).select("id_a", "id_b").collect()}
    assert found == {(c, c + 1) for c in range(0, len(sets), 4)}
    monkeypatch.setattr(tiles, "KEYS_EACH", 1)
    assert tiles.number_of_blocks(shared, 0.5) < tiles.number_of_blocks(shared)


def test_equal_sizes_are_spread_over_blocks(spark):
    """One size only: every bound is that size, and its classes still lie in several blocks."""
    rng = random.Random(9)
    base = [rng.getrandbits(62) for _ in range(20)]
    rows = [(rng.randrange(2**60), c, 20, 1, base[:-1] + [c]) for c in range(30)]
    reps = spark.createDataFrame(rows, "cls_hi long, cls_lo long, n long, members long, keys array<bigint>").localCheckpoint()
    seats = reps.select(F.col("cls_lo").alias("submission_id"), F.lit("p").alias("path"), F.lit("py").alias("ext"), *S.CLS, F.col("n").alias("n_shingles"), "members")
    shared = S.shared_sets(reps)
    assert tiles.dealt_rows(shared, seats, 2000, 0.7, 4).select("b").distinct().count() == 4
    assert tiles.file_pairs(shared, seats, 2000, 0.7, blocks=4).select("id_a", "id_b").distinct().count() == 30 * 29 // 2


def test_keys_are_not_written_by_class(spark):
    """All keys are read once for the shared ones, so no table of them is written."""
    from codesim.plans import analyze

    text = "\n".join(f"x{i} = {i}" for i in range(40)) + "\n"
    rows = [(s, f"s{s}", f"s{s}/a{p}.py", text + f"y = {s * p}\n") for s in range(3) for p in range(3)]
    a = analyze.analyze(spark.createDataFrame(rows, "submission_id long, submission string, raw_path string, content string"), overall_thresh=0.1)
    assert a.pairs.count() == 3 and a.flagged_files.count() > 0
    assert not [w for w in a.written if "/class_sets-" in w]
    a.cleanup()


def test_a_class_is_written_once_however_many_blocks(corpus, monkeypatch):
    """The tiles read the blocks from a table: nothing is shuffled for them, and a class stands in one block only."""
    reps, sets = corpus
    shared, seats = S.shared_sets(reps).localCheckpoint(), S.class_seats(sets, reps)
    tables = []

    def keep(df, name, rows_each):
        tables.append((name, rows_each, df.localCheckpoint()))
        return tables[-1][2]

    want = _rows(S.shared_shingle_counts(reps, sets))
    pairs = tiles.file_pairs(shared, seats, 2000, blocks=5, keep=keep)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        pairs.explain()
    assert "CartesianProduct" in out.getvalue() and "Exchange" not in out.getvalue()
    (name, rows_each, table), = tables
    blocks = [tiles._opened(pa.scalar(bytes(r.data), pa.binary()), 0.0) for r in table.collect()]
    classes = [c for t in blocks for c in zip(t["cls_hi"].to_pylist(), t["cls_lo"].to_pylist())]
    assert (name, rows_each) == ("tile_blocks", 1) and 2 < len(blocks) <= 5 and len(classes) == len(set(classes)) == shared.count()
    assert _rows(pairs.unionByName(S.within_class_pairs(seats))) == want
    # a table serves higher similarities too, in small slices of work as in large ones
    monkeypatch.setattr(tiles, "AT_ONCE", 50)
    for tau in (0.05, 0.6):
        again = tiles.file_pairs(shared, seats, 2000, tau, table=table)
        assert _rows(again) == _rows(tiles.file_pairs(shared, seats, 2000, tau, blocks=3))
    assert len(tables) == 1


def test_an_analysis_writes_its_blocks_once_and_deletes_them(spark):
    from codesim.plans import analyze

    text = "\n".join(f"x{i} = {i}" for i in range(40)) + "\n"
    rows = [(s, f"s{s}", f"s{s}/a{p}.py", text + f"y = {s * p}\n") for s in range(3) for p in range(3)]
    a = analyze.analyze(spark.createDataFrame(rows, "submission_id long, submission string, raw_path string, content string"), overall_thresh=0.1, prune=True)
    assert a.counts.count() == 27 and a.counts_at_least(0.7).count() == 27 and a.pairs.count() == 3
    written = [w for w in a.written if "/tile_blocks-" in w]
    assert len(written) == 1
    a.cleanup()
    assert not any(os.path.exists(w.removeprefix("file:")) for w in written)
