"""Line diff of file pairs: runs of equal, removed and added lines along a longest common subsequence.

A pair's lines travel as 64-bit line keys, so that a pair costs eight bytes a line; texts are
joined to the runs afterwards, by file and line number, only where they are asked for (``side_by_side``).

The alignment is exact: equal lines number as many as the longest common subsequence has.  Common head and tail go first;
what is left is split by Hirschberg's method: the first half of one file and the second half are each
matched with the other file, and the place where both matches add up to most splits that file.  The matching counts a whole block
of ``WORD`` lines at once (bit-parallel, a carry from block to block), so that memory is a few numbers a
line however long the files are, and time is lines times lines / ``WORD``.  Among equally long alignments the
split with the smallest line number is taken, so a pair's runs are always the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Lines matched at once.
WORD = 4096
KINDS = ("equal", "removed", "added")


def lcs_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """For each j from 0 to len(b), how long the longest common subsequence of ``a`` and b[:j] is."""
    grows = np.zeros(len(b), np.uint8)
    carry = bytearray(len(a))
    for at in range(0, len(b), WORD):
        part = b[at:at + WORD]
        full = (1 << len(part)) - 1
        places: dict[int, int] = {}
        for j, line in enumerate(part):
            places[line] = places.get(line, 0) | 1 << j
        v = full
        get = places.get
        for i, line in enumerate(a):
            here = get(line, 0)
            total = v + (v & here) + carry[i]
            carry[i] = total >> len(part)
            v = total & full | v & ~here
        # a zero bit: one more line in common
        bits = np.unpackbits(np.frombuffer(v.to_bytes(len(part) // 8 + 1, "little"), np.uint8), bitorder="little")
        grows[at:at + len(part)] = 1 - bits[:len(part)]
    return np.concatenate([[0], np.cumsum(grows, dtype=np.int64)])


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(line of ``a``, line of ``b``, lines): the equal runs of a longest common subsequence, in order."""
    out: list[tuple[int, int, int]] = []

    def equal(i: int, j: int, n: int) -> None:
        if n and out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        elif n:
            out.append((i, j, n))

    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        if m < 0:  # an equal run that waited for what stands before it
            equal(i, j, n)
            continue
        head = 0
        while i + head < m and j + head < n and a[i + head] == b[j + head]:
            head += 1
        equal(i, j, head)
        i, j = i + head, j + head
        tail = 0
        while m - tail > i and n - tail > j and a[m - 1 - tail] == b[n - 1 - tail]:
            tail += 1
        if tail:
            todo.append((m - tail, -1, n - tail, tail))
            m, n = m - tail, n - tail
        if i == m or j == n:
            continue
        if m - i == 1:
            if a[i] in b[j:n]:
                todo.append((i, -1, b.index(a[i], j, n), 1))
            continue
        half = (i + m) // 2
        ahead = lcs_lengths(a[i:half], b[j:n])
        behind = lcs_lengths(a[half:m][::-1], b[j:n][::-1])[::-1]
        split = j + int(np.argmax(ahead + behind))
        todo.append((half, m, split, n))
        todo.append((i, half, j, split))
    return out


def runs(a: list[int], b: list[int]) -> Iterator[tuple[str, int, int, int]]:
    """(kind, line of ``a``, line of ``b``, lines) of the whole diff, in order; removed lines come before added ones."""
    i = j = 0
    for x, y, n in [*aligned(a, b), (len(a), len(b), 0)]:
        if x > i:
            yield "removed", i, j, x - i
        if y > j:
            yield "added", x, j, y - j
        if n:
            yield "equal", x, y, n
        i, j = x + n, y + n


def line_keys(content) -> F.Column:
    """The 64-bit keys of a text's lines; empty for null."""
    return F.coalesce(F.transform(T.split_lines(content), lambda line: F.xxhash64(line)), F.array().cast("array<bigint>"))


KEY = ["id_a", "id_b", "path_a", "path_b"]


def diff_runs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(id_a, id_b, path_a, path_b, nth, kind, from_a, from_b, n): the runs of each pair of ``pairs``, numbered from 1, line numbers
    from 0.  ``files`` (submission_id, path, content) holds each file of the pairs once.  Two files without lines have no run."""
    keys = files.select("submission_id", "path", line_keys("content").alias("lines"))

    def side(s: str) -> DataFrame:
        return keys.select(F.col("submission_id").alias(f"id_{s}"), F.col("path").alias(f"path_{s}"), F.col("lines").alias(f"lines_{s}"))

    both = pairs.select(*KEY).join(side("a"), ["id_a", "path_a"]).join(side("b"), ["id_b", "path_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                a, b = (batch.column(i)[at].as_py() for i in (4, 5))
                found = list(runs(a, b))
                rows = pa.array([at] * len(found), pa.int64())
                cols = list(zip(*found)) if found else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(rows) for i in range(4)), pa.array(range(1, len(found) + 1), pa.int64()),
                     pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                    [*KEY, "nth", "kind", "from_a", "from_b", "n"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.select(*KEY).schema.fields)
    return both.select(*KEY, "lines_a", "lines_b").mapInArrow(run, f"{schema}, nth long, kind string, from_a long, from_b long, n long")


def diff_totals(pairs: DataFrame, runs_of: DataFrame) -> DataFrame:
    """Per pair: n_equal, n_removed, n_added lines, and n_runs."""
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in KINDS]
    totals = runs_of.groupBy(*KEY).agg(*sums, F.count(F.lit(1)).alias("n_runs"))
    zero = F.lit(0).cast("long")
    return pairs.select(*KEY).join(totals, KEY, "left").select(
        *KEY, *[F.coalesce(F.col(c), zero).cast("long").alias(c) for c in (*[f"n_{k}" for k in KINDS], "n_runs")])


def side_by_side(runs_of: DataFrame, files: DataFrame) -> DataFrame:
    """The two-column view: a row per line of the diff (id_a, id_b, path_a, path_b, nth, at, kind, line_a, text_a, line_b, text_b), line
    numbers from 1; the side that lacks the line is null.  Rows in order of (nth, at)."""
    at = runs_of.select(*KEY, "nth", "kind", "from_a", "from_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("at"))
    at = at.select(*KEY, "nth", "at", "kind",
                   F.when(F.col("kind") != "added", F.col("from_a") + F.col("at") + 1).alias("line_a"),
                   F.when(F.col("kind") != "removed", F.col("from_b") + F.col("at") + 1).alias("line_b"))
    texts = files.select("submission_id", "path", F.posexplode_outer(T.split_lines("content")).alias("i", "text")).where("text IS NOT NULL")

    def side(s: str) -> DataFrame:
        return texts.select(F.col("submission_id").alias(f"id_{s}"), F.col("path").alias(f"path_{s}"),
                            (F.col("i") + 1).cast("long").alias(f"line_{s}"), F.col("text").alias(f"text_{s}"))

    return at.join(side("a"), ["id_a", "path_a", "line_a"], "left").join(side("b"), ["id_b", "path_b", "line_b"], "left").select(
        *KEY, "nth", "at", "kind", "line_a", "text_a", "line_b", "text_b")
