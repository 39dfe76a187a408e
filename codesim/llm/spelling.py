"""Spelling variant grouping: words one edit apart, found by blocked Gram matrices of letter counts.

Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased.  Where ``every`` divides the crc32 of
``<doc_id>:<run>``, that crc32 modulo the run's length names a code point (from 0) that is deleted first; ``every=0`` deletes
nothing.  Results of at least ``min_length`` code points and ``min_count`` occurrences overall are the vocabulary.  Two words are near
if one inserted, deleted or replaced code point turns one into the other.  A word's form is its near word of
largest count (ties: smallest in code-point order), if that count is at least ``ratio`` times the word's; its root is what the forms
lead to.

One edit changes the squared distance of two letter-count vectors by 1 (insertion, deletion) or 2 (replacement), so that a
NumPy product of two blocks of such vectors (their Gram matrix) rules out nearly all other pairs at once: |x|^2 + |y|^2 - 2 x.y <= 2.
What is left is verified by its common head and tail.  Blocks are those of equal and of adjacent lengths.  As one edit leaves the
first l // 2 letters, or the others, of the shorter word (l letters) as they are, a block of lengths l and l + 1 is cut by
that head, and once more by that tail; every near pair shares one of the two.  A pair that shares both is reported by the head
alone.  A cut of more than ``tile`` words is dealt into tiles by hash, and every pair of tiles is a block
product of its own, so that a common head is spread over tasks and a product never holds more than about (2 ``tile``)^2 numbers.

All tables are sums over all documents; nothing comes to the driver but the number of words whose root still moves.

Defined results: null and empty texts have no words; a null doc_id counts as empty in ``<doc_id>:<run>``; repeated rows count each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Latin-1 bytes: A-Z lowered, other letters kept, all else a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: The place of a letter in the count vector.
DIMENSION = np.array([b - 97 if 97 <= b <= 122 else b - 0xC0 + 26 if b >= 0xC0 else 0 for b in range(256)])
N_LETTERS = 26 + 64
#: A task sends on its counts when it holds this many words.
HELD = 300_000


def cut_word(run: bytes, head: int, every: int) -> bytes:
    """The run (Latin-1) without the letter its crc32 names, if any; ``head`` is the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def words(docs: DataFrame, every: int = 97, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n: the vocabulary with its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])
            sums.clear()
            return got

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                seen: dict[bytes, int] = {}
                # whatever Latin-1 lacks becomes '?', which is no letter
                for w in text.as_py().encode("latin-1", "replace").translate(LETTERS).split():
                    seen[w] = seen.get(w, 0) + 1
                head = zlib.crc32(f"{doc_id}:".encode())
                for w, n in seen.items():
                    if every:
                        w = cut_word(w, head, every)
                    if len(w) >= min_length:
                        sums[w] = sums.get(w, 0) + n
                if len(sums) > HELD:
                    yield out()
        yield out()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def letter_counts(block: list[bytes]) -> np.ndarray:
    """One row of letter counts per word."""
    sizes = np.fromiter(map(len, block), np.int64, len(block))
    cells = np.repeat(np.arange(len(block)), sizes) * N_LETTERS + DIMENSION[np.frombuffer(b"".join(block), np.uint8)]
    return np.bincount(cells, minlength=len(block) * N_LETTERS).reshape(len(block), N_LETTERS).astype(np.float32)


def close(xs: list[bytes], ys: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of words whose letter counts are at most 2 apart in squared distance, from the product of the two blocks."""
    x, y = letter_counts(xs), letter_counts(ys)
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    for i, j in np.argwhere(square <= 2).tolist():
        yield xs[i], ys[j]


def near_in_block(length: int, tail: bool, mine: list[bytes], others: list[bytes] | None) -> Iterator[tuple[bytes, bytes]]:
    """Near pairs of a block: words of ``length`` with words of ``length`` or ``length + 1``; of two tiles, if
    ``others`` is given, else within one.  In a tail's block, pairs with a common head are left to the head's."""
    def pick(ws: list[bytes], n: int) -> list[bytes]:
        return [w for w in ws if len(w) == n]

    short, long = pick(mine, length), pick(mine, length + 1)
    if others is None:
        jobs = [(short, short), (short, long)]
    else:
        jobs = [(short, pick(others, length)), (short, pick(others, length + 1)), (pick(others, length), long)]
    half = length // 2
    for xs, ys in jobs:
        if xs and ys:
            for a, b in close(xs, ys):
                if (xs is not ys or a < b) and not (tail and a[:half] == b[:half]) and one_edit(a, b):
                    yield a, b


def near_pairs(vocabulary: DataFrame, tile: int = 2048) -> DataFrame:
    """a, b: every near pair of the table's words, once."""
    size = F.length("word")

    def place(length, tail: bool) -> F.Column:
        half = F.floor(length / 2).cast("int")
        part = F.substring("word", size - (length - half) + 1, length - half) if tail else F.substring("word", F.lit(1), half)
        return F.struct(length.cast("int").alias("length"), F.lit(tail).alias("tail"), part.alias("part"))

    blocks = F.array(*(place(size - d, tail) for d in (0, 1) for tail in (False, True)))
    rows = vocabulary.select("word", F.explode(blocks).alias("block"))
    sizes = rows.groupBy("block").agg(F.count("*").alias("m"), F.count(F.when(F.col("block.length") == size, 1)).alias("short"))
    # a block without a shorter word, or with one word only, has no pair
    live = sizes.where("m > 1 AND short > 0").select("block", F.ceil(F.col("m") / tile).cast("int").alias("k"))
    tiled = rows.join(live, "block").withColumn("t", F.pmod(F.xxhash64("word"), F.col("k")).cast("int"))
    tiled = tiled.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tiled = tiled.select("block.length", "block.tail", "block.part", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), (F.col("t") > F.col("o")).alias("second"), "word")
    group = ["length", "tail", "part", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[bytes, bytes]] = []
        at, mine, others = None, [], []

        def solve() -> Iterator[tuple[bytes, bytes]]:
            if at is None:
                return iter(())
            return near_in_block(at[0], at[1], mine, others if at[3] != at[4] else None)

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in side], pa.string()) for side in (zip(*found) if found else ((), ()))], ["a", "b"])
            found.clear()
            return got

        for b in batches:
            for *key, second, word in zip(*(c.to_pylist() for c in b.columns)):
                if key != at:
                    found.extend(solve())
                    at, mine, others = key, [], []
                    if len(found) > 50_000:
                        yield out()
                (others if second else mine).append(word.encode("latin-1"))
        found.extend(solve())
        yield out()

    return tiled.repartition(*group).sortWithinPartitions(*group, "second").mapInArrow(run, "a string, b string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from (word, form), where the forms of each word lead to.  Counts double along a form at least, so there is no
    circle; each round, a stored table, doubles the steps taken."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = stored(at.join(step, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.drop("moved")
        if not moved.where("moved").count():
            return at


def variants(docs: DataFrame, every: int = 97, min_length: int = 5, min_count: int = 3, ratio: int = 2, tile: int = 2048) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the vocabulary."""
    vocabulary = stored(words(docs, every, min_length, min_count))
    pairs = near_pairs(vocabulary, tile)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.word", "p.near")
    counts = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    fits = F.col("best.minus") <= -ratio * F.col("n")
    found = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"))
    found = stored(found)
    return found.join(roots(found.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
