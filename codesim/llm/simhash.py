"""SimHash near-duplicates by BK-trees.

Every text gets a 64-bit fingerprint: words of the ASCII-lower-cased text,
shingles of ``shingle`` words, XXH64 (seed 42) of each, and a bit is one where
more than half of the shingle hashes have it.  Two fingerprints link when they
differ in at most ``radius`` bits; linked texts form components.

Links are found among distinct fingerprints only, so a group of exact copies
is one entry however large it is.  The 64 bits are cut into ``blocks`` blocks; fingerprints within ``radius`` bits
agree in all but ``radius`` of them, so each goes to one *shard* per choice of ``blocks - radius`` blocks (the choice
and the bits' value) and every link lies inside a shard.  With the number of fingerprints the number of blocks grows (4 up to 134
million, 5 up to 69 billion), and with it the bits of a shard, so that evenly spread fingerprints keep shards
under ``tile`` and each is copied 4, 10, 20 times, not in proportion to their number.  A shard is a BK-tree:
children hang on their parent under the integer Hamming distance, and a search
follows only edges within ``radius`` of the distance at hand.  Shards of more than
``tile`` entries are cut into tiles by a hash; every pair of tiles is its own
group, so a hot shard is spread over tasks and a tree never holds more than
about ``tile`` nodes.  The trees stay in the tasks of their shard: broadcasting all
of them would send every fingerprint to every worker, which has no size bound.

A group reports only a spanning star of each linked cluster, never its
pairs.  The stars are merged by large-star/small-star rounds over stored tables.

Defined results: null and empty texts have fingerprint zero and link like any other;
repeated rows get the same answer; a component whose rows all lack a doc_id has a null
component_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_key, unused

SEED = 42
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 of the space-joined shingles, repeats included."""
    words = text.lower().split()  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint per run of ``sizes`` hashes; an empty run gives zero.

    Bits are counted in byte lanes: (h >> k) & 0x0101.. holds bits k, k+8, .. and up to
    255 of them can be added without overflow."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    pieces = -(-n // 255)
    first = np.repeat(np.cumsum(n) - n, pieces)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts, heads = first + 255 * nth, np.cumsum(pieces) - pieces
    fp = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        ones = (2 * counts > n[:, None]).astype(np.uint64)
        for byte in range(8):
            fp |= ones[:, byte] << np.uint64(8 * byte + k)
    out[full] = fp
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, key (of the text), fp (the 64 bits as a signed long), one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [shingle_hashes(t or b"", shingle) for t in b.column(2).cast(pa.binary()).to_pylist()]
            sizes = np.array([len(r) for r in runs], np.int64)
            hashes = np.fromiter((h for r in runs for h in r), np.uint64, int(sizes.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(majority_bits(hashes, sizes).view(np.int64))], ["doc_id", "key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), "text").mapInArrow(run, "doc_id long, key long, fp long")


class BKTree:
    """Nodes in insertion order; children[i] maps a distance to a node's child."""

    def __init__(self, keys: list[int]):
        self.keys, self.children = keys, [{} for _ in keys]
        for i in range(1, len(keys)):
            at, key = 0, keys[i]
            while True:
                d = (keys[at] ^ key).bit_count()
                child = self.children[at].get(d)
                if child is None:
                    self.children[at][d] = i
                    break
                at = child

    def links(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
        """(numbers of the queries within the radius, node), node by node; each node
        is compared at once with all queries that follow an edge to it."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, live = todo.pop()
            d = np.bitwise_count(queries[live] ^ np.uint64(self.keys[node])).astype(np.int64)
            near = live[d <= radius]
            if len(near):
                yield near, node
            for edge, child in self.children[node].items():
                follow = live[np.abs(d - edge) <= radius]
                if len(follow):
                    todo.append((child, follow))


def stars(tree_keys: list[int], queries: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(fingerprint, smallest linked one) for a spanning star of every cluster."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    arr = np.array(queries, np.uint64)
    for near, node in BKTree(tree_keys).links(arr, radius):
        a = find(tree_keys[node])
        for q in near.tolist():
            b = find(queries[q])
            if a != b:
                a, b = min(a, b), max(a, b)
                top[b] = a
    for x in list(top):
        if (root := find(x)) != x:
            yield x, root


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Runs of equal (blocks, shard, i, j) of a sorted partition, as rows (blocks, shard, i, j, side, fp)."""
    held = np.zeros((0, 6), np.int64)
    for b in batches:
        held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)])
        if not len(held):
            continue
        cuts = np.flatnonzero((held[1:, :4] != held[:-1, :4]).any(axis=1)) + 1
        runs = np.split(held, cuts)
        yield from (r for r in runs[:-1] if len(r) > 1)
        held = runs[-1]
    if len(held) > 1:
        yield held


def masks(blocks: int, radius: int) -> list[int]:
    """The bits of every choice of ``blocks - radius`` of ``blocks`` blocks of the 64 bits; fingerprints within
    ``radius`` bits agree in all bits of one choice at least."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    return [sum(c) for c in combinations(each, blocks - radius)]


def enough_blocks(n: int, radius: int, tile: int) -> int:
    """The least number of blocks at which evenly spread fingerprints, ``n`` of them, fill no shard beyond ``tile``."""
    blocks = radius + 1
    while blocks < 64 and n > tile << min(m.bit_count() for m in masks(blocks, radius)):
        blocks += 1
    return blocks


def links(distinct: DataFrame, radius: int = 3, tile: int = 2048, blocks: int | None = None) -> DataFrame:
    """(u, v), v < u unsigned: stars that connect exactly the linked distinct fingerprints."""
    chosen = masks(blocks or enough_blocks(distinct.count(), radius, tile), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    places = F.array(*(F.struct(F.lit(i).cast("long").alias("blocks"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("shard")) for i, m in enumerate(signed)))
    entries = distinct.select("fp", F.explode(places).alias("b")).select("b.blocks", "b.shard", "fp")
    hot = entries.groupBy("blocks", "shard").count().where(F.col("count") > tile).select("blocks", "shard", F.ceil(F.col("count") / tile).cast("long").alias("k"))
    tiled = entries.join(hot, ["blocks", "shard"], "left").select("blocks", "shard", "fp", F.coalesce("k", F.lit(1).cast("long")).alias("k")).withColumn("t", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")))
    # tile t is searched in the trees of tiles 0..t and is itself the tree for tiles t..k-1
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda o: F.struct(F.least(o, F.col("t")).alias("i"), F.greatest(o, F.col("t")).alias("j"), F.when(o > F.col("t"), 0).when(o < F.col("t"), 1).otherwise(2).cast("long").alias("side")))
    group = ["blocks", "shard", "i", "j"]
    rows = tiled.select("blocks", "shard", "fp", F.explode(pairs).alias("p")).select("blocks", "shard", "p.i", "p.j", "p.side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for g in _groups(batches):
            side, fp = g[:, 4], np.ascontiguousarray(g[:, 5]).view(np.uint64)
            keys, queries = fp[side != 1].tolist(), fp[side != 0].tolist()
            if keys and queries:
                for u, v in stars(keys, queries, radius):
                    us.append(u)
                    vs.append(v)
            if len(us) >= 50_000:
                yield _edges(us, vs)
                us, vs = [], []
        yield _edges(us, vs)

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "u long, v long").distinct()


def _edges(us: list[int], vs: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex but the roots themselves, by alternating large-star and
    small-star rounds until the edges no longer change.  Each round is a stored table.
    Vertices are longs; the root is the smallest in signed order."""
    at = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    size = ("count(1) AS n", "bit_xor(xxhash64(u, v)) AS x")
    seen = at.selectExpr(*size).first()
    while seen.n:
        # large star: every larger neighbour of u goes to u's smallest neighbour
        both = at.union(at.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        at = stored(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        now = at.selectExpr(*size).first()
        if (now.n, now.x) == (seen.n, seen.x):
            break
        seen = now
    return at.select("u", F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, tile: int = 2048) -> DataFrame:
    """doc_id, key, fp, root, component_id: one row per row of ``docs``; root names the component and component_id is the
    smallest doc_id of the texts reachable over links, the row's own included."""
    prints = stored(fingerprints(docs, shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(distinct.select("fp"), radius, tile))
    rooted = distinct.join(roots, distinct["fp"] == roots["u"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "key", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id; where rows repeat that
    id, or the component has no id at all, the one with the smallest text key, and one of equal rows."""
    of, key = unused(docs, "of", "text_key")
    found = near_duplicates(docs, shingle, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = found.groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    kept = stored(rows.groupBy("root").agg(F.min(F.struct("key", "doc_id", "n")).alias("best")).select(F.col("best.key").alias(key), F.col("best.doc_id").alias(of), F.col("best.n").alias("n")))
    same = docs["doc_id"].eqNullSafe(F.col(of)) & (text_key(docs["text"]) == F.col(key))
    once, more = (kept.where(c).select(of, key) for c in ("n = 1", "n > 1"))
    repeated = docs.join(more, same, "left_semi").withColumn(key, text_key(F.col("text"))).dropDuplicates(["doc_id", key]).drop(key)
    return docs.join(once, same, "left_semi").unionByName(repeated)
