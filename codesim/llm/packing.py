"""Best-fit-decreasing packing of token windows.

A document's ids (byte-level BPE, then the end id) are cut into full windows of ``size`` ids and one
rest, so pieces, their checksums and their lengths are known in one pass over the texts, before
anything is packed.  The packing needs only how many pieces there are of each length, at most
``size`` numbers however large the corpus: lengths go in decreasing order, and a segment tree over remaining
capacity 1..size finds the tightest capacity at which a window is open.  All windows with the same
remaining capacity are alike, so they are held as intervals of window numbers and take pieces
of one length together; the outcome is that of best-fit decreasing piece by piece, in
a number of steps that depends on ``size`` alone.  The plan is a small table of (length, ranks, windows);
the task that cuts the pieces numbers those of equal length, and the counts by (length, task) before it make that
number a rank among all pieces, so that no piece is sorted or shuffled for it, however many share a length, an id or a text.
The cut pieces are stored once, which fixes their numbers.

The vocabulary file is read by the driver and sent to the workers.  Ids are those that
tokenizers gives (special strings in a text included); the file's merges run in tiktoken, which needs a sixth of the CPU.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; rows
without doc_id are packed like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: The split of byte-level BPE (a fixed value of the vocabulary's kind).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        self.special = [t["content"] for t in parsed.get("added_tokens", [])]
        # byte-level files write each byte as a printable character: printable Latin-1 stands for
        # itself, the other bytes are U+0100 and up in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        skip = set(self.special)
        ranks = {bytes(byte[c] for c in piece): i for piece, i in parsed["model"]["vocab"].items() if piece not in skip}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return np.asarray(self.fast.encode_to_numpy(text), np.uint32)
        except ValueError:  # its pattern matcher gives up on very long runs of blanks
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, size: int = 2048, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows and a rest for each document; part and nth: the task that made the
    piece and the piece's number among that task's pieces of equal length."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file of a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec.value)
        end = np.array([end_id], "<u4")
        part, made = TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows, out = [], [[], [], [], [], [], []]
            for n, text in enumerate(b.column(1)):
                ids = np.concatenate([encoder.ids(text.as_py() or ""), end]).astype("<u4")
                for start in range(0, len(ids), size):
                    cut = ids[start:start + size]
                    rows.append(n)
                    for c, v in zip(out, (start, len(cut), zlib.crc32(cut), len(ids), part, made[len(cut)])):
                        c.append(v)
                    made[len(cut)] += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long")


class Capacities:
    """Segment tree over remaining capacity; a leaf counts the open intervals there."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += change
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that is open."""
        i = least + self.leaves
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first window, pieces a window, offset): pieces of that length
    and ranks go to consecutive windows, so many to each, from that offset on."""
    plan, windows = [], 0
    tree, open_at = Capacities(size), defaultdict(list)

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_at[capacity].append((first, n))
            tree.add(capacity, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = size
                first, n = windows, -(-left // (size // length))
                windows += n
            else:
                first, n = open_at[capacity].pop()
                tree.add(capacity, -1)
            each = capacity // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, size - capacity))
                rank, left = rank + full * each, left - full * each
                put(capacity - each * length, first, full)
            if full < n and left:
                plan.append((length, rank, left, first + full, left, size - capacity))
                put(capacity - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(capacity, first + full, n - full)
    return plan


def packed(docs: DataFrame, size: int = 2048, end_id: int = 1, vocabulary: str | None = None, max_broadcast: int = 200_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, size, end_id, vocabulary))
    counts = cut.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))  # at most ``size`` rows a task
    before = stored(counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")))
    totals = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    plan = best_fit_decreasing(totals, size)
    schema = "_length long, first long, n long, window long, each long, from long"
    plan = spark.createDataFrame(plan, schema)  # a few rows for each length
    before = before.select("length", "part", "before")
    before = F.broadcast(before) if before.count() <= max_broadcast else before
    ranked = cut.join(before, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    on = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    placed = ranked.join(F.broadcast(plan), on)
    within = F.col("rank") - F.col("first")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("window") + F.floor(within / F.col("each"))).alias("sequence_id"), (F.col("from") + F.pmod(within, F.col("each")) * F.col("length")).alias("offset"))
