"""File pairs of content classes, counted in tiles.

A key of m classes gives m^2 class pairs.  A join of the keys therefore sends the square of the input through a shuffle, before
and after it is counted.  Here classes are dealt to blocks, a block is a row of a stored table, and each pair of blocks (a tile) is a row of
the product of that table with itself: it holds the key arrays and files of both blocks, counts the shared keys of a class with all others
at once and gives out the file pairs straight away.  The product reads the table, so a class is shuffled and written once, however many
blocks it meets, and no pair ever is.  The number of blocks follows the number of keys,
so a tile's memory does not grow with the input.  Above a least similarity only classes that can reach it are dealt, to blocks by their
size, and blocks of too different sizes don't meet.  It changes how the work is divided, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import materialise
from .blocks import blocked

CLS = ["cls_hi", "cls_lo"]
EPS = 1e-9
#: Keys of a block, about; pairs that are looked at together; rows of a batch of the result.
KEYS_EACH, AT_ONCE, ROWS_OUT = 1_000_000, 2_000_000, 50_000


def able(classes: DataFrame, tau: float) -> DataFrame:
    """The classes that can reach ``tau``: those have as many shared keys as that share of all their keys.  Keys that meet by chance grow
    faster than the input, but most of their classes have too few of them."""
    return classes.where(F.size("keys") >= tau * F.col("n") - EPS) if tau > 0 else classes


def number_of_blocks(classes: DataFrame, tau: float = 0.0) -> int:
    """So many that a block has about ``KEYS_EACH`` keys of classes that can reach ``tau``, and every core a few tiles."""
    keys = able(classes, tau).agg(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    return max(math.ceil(keys / KEYS_EACH), math.ceil(math.sqrt(6 * classes.sparkSession.sparkContext.defaultParallelism)))


def _bounds(classes: DataFrame, blocks: int) -> list[int]:
    """Numbers of shingles that cut the keys of ``classes`` into ``blocks`` equal parts."""
    marks = [k / blocks for k in range(1, blocks)]
    return list(classes.agg(F.percentile("n", F.array(*map(F.lit, marks)), F.greatest(F.size("keys"), F.lit(1)))).first()[0] or []) if marks else []


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (count[0] numbers), start[1], .."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _slices(count: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of ``count`` that sum up to about ``AT_ONCE`` at most."""
    marks = np.flatnonzero(np.diff(np.cumsum(count) // AT_ONCE)) + 1
    ends = [0, *marks.tolist(), len(count)]
    return list(zip(ends, ends[1:]))


class _Lists:
    """The lists of a column: offsets of the rows, flat numbers (equal for equal values) and the row of each."""

    def __init__(self, column: pa.Array):
        self.off = np.concatenate([[0], np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
        flat = column.flatten()
        self.flat = (flat if pa.types.is_integer(flat.type) else flat.dictionary_encode().indices).to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(self.off))


class _Postings:
    """The rows from ``first`` on by their values."""

    def __init__(self, lists: _Lists, first: int, within: np.ndarray | None = None):
        at = np.arange(lists.off[first], len(lists.flat))
        at = at if within is None else at[within[at]]
        self.at = at[np.argsort(lists.flat[at], kind="stable")]
        self.value, self.row = lists.flat[self.at], lists.row[self.at]

    def places(self, lists: _Lists, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """For the values of the rows before ``upto``: where equal ones begin and end."""
        mine = lists.flat[:lists.off[upto]]
        order = np.argsort(mine, kind="stable")
        lo, hi = np.empty(len(mine), np.int64), np.empty(len(mine), np.int64)
        lo[order], hi[order] = np.searchsorted(self.value, mine[order], "left"), np.searchsorted(self.value, mine[order], "right")
        return lo, hi


def _tile(t: pa.Table, i: int, j: int, tau: float, most: float | None, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, other rows, their common keys) of a tile whose first ``end`` rows are those of block ``i``.  With ``tau`` only pairs that reach it, found by
    their rarest keys; by equal probes instead, where there are some."""
    n = t["n"].to_numpy()
    hi, lo = (t[c].to_numpy() for c in CLS)
    order = np.lexsort((lo, hi))
    code = np.empty(len(n), np.int64)
    code[order] = np.concatenate([[0], np.cumsum((np.diff(hi[order]) != 0) | (np.diff(lo[order]) != 0))])
    first = 0 if i == j else end
    if end == 0 or first == t.num_rows:
        return
    keys = _Lists(t["keys"].combine_chunks() if isinstance(t["keys"], pa.ChunkedArray) else t["keys"])
    full = _Postings(keys, first)
    lo, hi = full.places(keys, end)
    bands = "probe" in t.column_names
    if bands:
        bits = [t[c].to_numpy() for c in ("bits_1", "bits_2")]
        seek = _Lists(t["probe"].combine_chunks())
        found = _Postings(seek, first)
        f_lo, f_hi = found.places(seek, end)
        start = seek.off[:-1]
    elif tau > 0:
        # the frequent keys stand first, so a key's place is the number of keys from it on to the end of the order
        rest = n - (n - np.ceil(tau * n - EPS) + 1)
        start = keys.off[:-1] + np.clip(rest, 0, np.diff(keys.off)).astype(np.int64)
        place = np.arange(len(keys.flat)) - keys.off[keys.row] + 1
        seek, found = keys, _Postings(keys, first, np.arange(len(keys.flat)) >= start[keys.row])
        f_lo, f_hi = found.places(keys, end)
    else:
        seek, found, f_lo, f_hi, start = keys, full, lo, hi, keys.off[:-1]
    if tau > 0:
        # a key's number is the first place of its equals
        begins = np.concatenate([[True], full.value[1:] != full.value[:-1]])[:len(full.value)]
        number = np.empty(len(keys.flat), np.int64)
        number[full.at] = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0))
        mark = np.zeros(len(full.value), bool)
    at = np.arange(seek.off[end])
    at = at[at >= start[seek.row[at]]]
    count, of = f_hi[at] - f_lo[at], seek.row[at]
    width = t.num_rows - first
    for a0, a1 in _slices(np.bincount(of, count, end).astype(np.int64) + width):
        s, e = np.searchsorted(of, (a0, a1))
        inter = np.zeros((a1 - a0) * width, np.int64)
        for u, v in _slices(count[s:e]):
            here = at[s + u:s + v]
            met = _ranges(f_lo[here], count[s + u:s + v])
            other, mine = found.row[met], np.repeat(of[s + u:s + v], count[s + u:s + v])
            cell = (mine - a0).astype(np.int64) * width + (other - first)
            if tau <= 0:
                inter += np.bincount(cell, minlength=len(inter))
                continue
            ok = (n[other] >= tau * n[mine] - EPS) & (n[other] <= n[mine] / tau + EPS)
            if not bands:
                room = np.minimum(np.repeat(place[here], count[s + u:s + v]), place[found.at[met]])
                ok &= room * (1 + tau) >= tau * (n[mine] + n[other]) - EPS
            inter[cell[ok]] = 1
        cell = np.flatnonzero(inter)
        mine, near = a0 + cell // width, first + cell % width
        good = code[near] > code[mine] if i == j else np.ones(len(cell), bool)
        if bands:
            good &= sum(np.bitwise_count((x[near] ^ x[mine]).view(np.uint64)).astype(int) for x in bits) <= most
        mine, near = mine[good], near[good]
        if tau <= 0:
            yield mine, near, inter[cell[good]]
            continue
        heads = np.flatnonzero(np.diff(mine, prepend=-1))
        for a, near in zip(mine[heads].tolist(), np.split(near, heads[1:])):
            own = slice(keys.off[a], keys.off[a + 1])
            held = lo[own][hi[own] > lo[own]]
            mark[held] = True
            size = keys.off[near + 1] - keys.off[near]
            common = np.zeros(len(near), np.int64)
            for u, v in _slices(size):
                hits = mark[number[_ranges(keys.off[near[u:v]], size[u:v])]]
                common[u:v] = np.diff(np.concatenate([[0], np.cumsum(hits)])[np.concatenate([[0], np.cumsum(size[u:v])])])
            mark[held] = False
            reach = (common > 0) & (common / (n[a] + n[near] - common) >= tau)
            if reach.any():
                yield np.full(int(reach.sum()), a), near[reach], common[reach]


def _expanded(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], t: pa.Table) -> Iterator[pa.RecordBatch]:
    """The file pairs of row pairs, in different submissions, the smaller id first."""
    files = t["files"].combine_chunks()
    off = np.concatenate([[0], np.cumsum(files.value_lengths().to_numpy())]).astype(np.int64)
    flat = files.flatten()
    ids, paths = flat.field("submission_id"), flat.field("path")
    values = ids.to_pylist()
    place = {v: k for k, v in enumerate(sorted(set(values)))}
    order = np.array([place[v] for v in values], np.int64)
    row = np.repeat(np.arange(len(files)), np.diff(off))
    n, ext = t["n"].combine_chunks(), t["ext"].combine_chunks()
    held, size = [], 0

    def batches() -> Iterator[pa.RecordBatch]:
        x, y, inter = (np.concatenate(c) for c in zip(*held))
        first = order[x] < order[y]
        a, b = np.where(first, x, y), np.where(first, y, x)
        for u in range(0, len(a), ROWS_OUT):
            p, q, k = (pa.array(c[u:u + ROWS_OUT]) for c in (a, b, inter))
            cells = [ids.take(p), paths.take(p), ids.take(q), paths.take(q), k, ext.take(pa.array(row[p])), n.take(pa.array(row[p])), n.take(pa.array(row[q]))]
            yield pa.RecordBatch.from_arrays(cells, ["id_a", "path_a", "id_b", "path_b", "inter", "ext", "n_a", "n_b"])

    for mine, near, inter in found:
        wide = off[near + 1] - off[near]
        each = (off[mine + 1] - off[mine]) * wide
        for u, v in _slices(each):
            pair, k = np.repeat(np.arange(u, v), each[u:v]), _ranges(np.zeros(v - u, np.int64), each[u:v])
            x, y = off[mine[pair]] + k // wide[pair], off[near[pair]] + k % wide[pair]
            other = order[x] != order[y]
            held.append((x[other], y[other], inter[pair[other]]))
            size += len(held[-1][0])
            if size >= ROWS_OUT:
                yield from batches()
                held, size = [], 0
    if size:
        yield from batches()


def dealt_rows(classes: DataFrame, seats: DataFrame, limit: int, tau: float, blocks: int) -> DataFrame:
    """The files and keys of the classes with their block b, once for each tile (i, j) in which the block meets one."""
    classes = able(classes, tau)
    dealt = blocked(seats.where(F.col("submission_id").isNotNull()), CLS, ["submission_id", "path"], limit, size="members")
    rows = dealt.groupBy(*CLS, "_t").agg(F.collect_list(F.struct("submission_id", "path")).alias("files"), F.first("ext").alias("ext"))
    more = [c for c in ("probe", "bits_1", "bits_2") if c in classes.columns]
    rows = rows.join(classes.select(*CLS, F.col("n").cast("long").alias("n"), "keys", *more), CLS)
    rank = F.col("cls_hi") / F.lit(float(2**60))
    if tau > 0 and "probe" not in more:
        # blocks are ranges of n, so those too far apart for ``tau`` don't meet; classes on a bound are spread over the blocks it ends
        cuts = _bounds(classes, blocks)
        ends = [0.0, *cuts, math.inf]
        low, high = (sum([(F.col("n") > c if s else F.col("n") >= c).cast("int") for c in cuts], F.lit(0)) for s in (True, False))
        block = low + F.least(F.floor(rank * (high - low + 1)), high - low)
        meets = [[o for o in range(len(cuts) + 1) if ends[min(o, b) + 1] >= tau * ends[max(o, b)] - EPS] for b in range(len(cuts) + 1)]
        others = F.element_at(F.array(*(F.array(*map(F.lit, m)) for m in meets)), F.col("b") + 1)
    else:
        block = F.least(F.floor(rank * blocks), F.lit(blocks - 1))
        others = F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = rows.withColumn("b", block.cast("int")).withColumn("_o", F.explode(others))
    return rows.withColumn("i", F.least("b", "_o")).withColumn("j", F.greatest("b", "_o")).drop("_o", "_t")


def stored_blocks(classes: DataFrame, seats: DataFrame, limit: int, tau: float, blocks: int, keep: Callable[..., DataFrame] | None = None) -> DataFrame:
    """(b, low, high, data): the blocks of ``dealt_rows``, each a row of a file of its own with its least and largest n, written by ``keep``."""
    rows = dealt_rows(classes, seats, limit, tau, blocks).where(F.col("i") == F.col("j")).drop("i", "j")
    return (keep or (lambda df, *a: materialise(df, *a)[0]))(packed(rows, blocks), "tile_blocks", 1)


def _nullable(kind: pa.DataType) -> pa.DataType:
    """``kind`` with elements that may be null, as which of them can't depends on where rows come from."""
    if pa.types.is_list(kind):
        return pa.list_(_nullable(kind.value_type))
    return pa.struct([(f.name, _nullable(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (cls_hi, cls_lo, n, ext, files, keys, b) by their block b: (b, low, high, data)."""
    columns = sorted(c for c in rows.columns if c != "b")

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).select(columns)
        t = t.cast(pa.schema([(f.name, _nullable(f.type)) for f in t.schema]))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        n = t["n"].to_numpy()
        cells = [pa.array([key[0].as_py()], pa.int32()), pa.array([n.min()], pa.int64()), pa.array([n.max()], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cells, ["b", "low", "high", "data"])

    # hashing is uneven over few blocks
    return rows.repartition(2 * blocks, "b").groupBy("b").applyInArrow(pack, "b int, low long, high long, data binary")


def _opened(data: pa.Scalar, tau: float) -> pa.Table:
    t = pa.ipc.open_stream(data.as_buffer()).read_all()
    if tau > 0:  # the table may be one of a lower tau
        size = np.nan_to_num(t["keys"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
        t = t.filter(pa.array(size >= tau * t["n"].to_numpy() - EPS))
    return t


def file_pairs(classes: DataFrame, seats: DataFrame, limit: int, tau: float = 0.0, most: float | None = None, blocks: int | None = None,
               keep: Callable[..., DataFrame] | None = None, table: DataFrame | None = None) -> DataFrame:
    """(id_a, path_a, id_b, path_b, inter, ext, n_a, n_b) of the files of different classes and submissions that share a key or, above
    zero, whose Jaccard is at least ``tau``.

    ``classes``: (cls_hi, cls_lo, n, keys), the frequent keys before the rare; pairs that reach ``tau`` are found by the prefix filter.  With the
    columns probe (a list), bits_1 and bits_2, only pairs with a probe in common and at most ``most`` different bits are.
    ``seats``: (submission_id, path, ext, cls_hi, cls_lo, members); the files of a large class are dealt to several rows.
    ``table``: their ``stored_blocks`` of this ``tau`` or a lower one, if they are written already; else ``keep`` writes them."""
    if table is None:
        table = stored_blocks(classes, seats, limit, tau, blocks or number_of_blocks(classes, tau), keep)

    near = (F.col("high_i") >= tau * F.col("low_j") - EPS) & (F.col("high_j") >= tau * F.col("low_i") - EPS)
    return _product(table, table, (F.col("i") <= F.col("j")) & near, seats, tau, most)


def pairs_between(table: DataFrame, other: DataFrame, seats: DataFrame) -> DataFrame:
    """The rows of ``file_pairs`` for the files of ``table`` with those of ``other``, both of blocks as ``packed``."""
    return _product(table, other.withColumn("b", -1 - F.col("b")), F.col("i") != F.col("j"), seats)


def _product(table: DataFrame, other: DataFrame, meet: F.Column, seats: DataFrame, tau: float = 0.0, most: float | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                i, j = (rows.column(c)[k].as_py() for c in ("i", "j"))
                t = _opened(rows.column("data_i")[k], tau)
                end = t.num_rows
                t = (t if i == j else pa.concat_tables([t, _opened(rows.column("data_j")[k], tau)])).combine_chunks()
                if t.num_rows:
                    yield from _expanded(_tile(t, i, j, tau, most, end), t)

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.select(F.col("b").alias(s), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"), F.col("data").alias(f"data_{s}")).hint("shuffle_replicate_nl")

    met = side(table, "i").join(side(other, "j"), meet).select("i", "j", "data_i", "data_j")
    id_ = seats.schema["submission_id"].dataType
    out = StructType([StructField("id_a", id_), StructField("path_a", StringType()), StructField("id_b", id_), StructField("path_b", StringType()),
                      StructField("inter", LongType()), StructField("ext", StringType()), StructField("n_a", LongType()), StructField("n_b", LongType())])
    return met.mapInArrow(run, out)
