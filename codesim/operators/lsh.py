"""Candidate search by MinHash bands (locality-sensitive hashing) with an exact check.

The content class of a file has a signature of ``N_HASHES`` minima, made in one pass over its key array. The signature is cut into
bands of ``rows`` minima; classes that agree in a whole band are candidates.  ``rows_for`` takes the longest band at
which a pair of similarity tau is still a candidate with probability ``recall`` or more, so the search is approximate: a pair
just over tau may be missed with probability 1 - ``recall``, more similar ones hardly ever.  What is returned is exact:
candidates are verified by their key arrays.  The exact way without loss is ``similarity.pairs_at_least``.

Bands meet in ``tiles``, where those are given, or through ``blocks.self_pairs``, so a band value that a third of all classes share is cut into blocks and
no pair of it is dropped.  Before the key arrays are fetched, candidates pass a filter on one bit of each minimum (two longs
a class), four standard deviations wide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .blocks import LIMIT, self_pairs
from .fingerprint import N_HASHES, PRIME, hash_parameters
from .similarity import CLS, CLS_PAIR, EPS, class_rank, class_seats, expand_class_pairs, positive_similarities, verified, within_class_pairs


def rows_for(tau: float, recall: float = 0.995, n: int = N_HASHES) -> int:
    """The most minima a band can have so that a pair of similarity ``tau`` shares one of the n // rows bands
    with probability ``recall``; 1 if none can."""
    fits = [r for r in range(1, n + 1) if 1 - (1 - tau ** r) ** (n // r) >= recall]
    return max(fits, default=1)


def minima(keys: np.ndarray) -> np.ndarray:
    """The minima of a set of 64-bit keys."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) & np.uint64(PRIME)
    a, b = (np.array(p, np.uint64) for p in zip(*hash_parameters()))
    out = np.full(N_HASHES, PRIME, np.uint64)
    for at in range(0, len(x), 4096):  # bounded, however large the set
        out = np.minimum(out, ((x[at:at + 4096, None] * a + b) % np.uint64(PRIME)).min(0))
    return out.astype(np.int64)


def signatures(reps: DataFrame) -> DataFrame:
    """(cls_hi, cls_lo, n, sig, bits_1, bits_2) of the classes with keys: the minima and the lowest bit of each."""
    keys = F.col("keys")
    if dict(reps.dtypes)["keys"] == "array<string>":
        keys = F.transform(keys, lambda k: F.xxhash64(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, flat = b.column(3).offsets.to_numpy(), b.column(3).values.to_numpy()
            sigs = np.array([minima(flat[i:j].view(np.uint64)) for i, j in zip(ends, ends[1:])], np.int64).reshape(-1, N_HASHES)
            bits = np.packbits((sigs & 1).astype(np.uint8), axis=1).view(">i8").astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * N_HASHES), pa.array(sigs.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists, pa.array(bits[:, 0]), pa.array(bits[:, 1])], [*CLS, "n", "sig", "bits_1", "bits_2"])

    rows = reps.where(F.size("keys") > 0).select(*CLS, F.col("n").cast("long").alias("n"), keys.alias("keys"))
    return rows.mapInArrow(run, "cls_hi long, cls_lo long, n long, sig array<bigint>, bits_1 long, bits_2 long")


def bands(reps: DataFrame, tau: float, recall: float = 0.995) -> DataFrame:
    """(cls_hi, cls_lo, n, bits_1, bits_2, bands)."""
    rows = rows_for(tau, recall)
    hashed = F.array(*(F.xxhash64(F.lit(i), *(F.element_at("sig", i * rows + j + 1) for j in range(rows))) for i in range(N_HASHES // rows)))
    return signatures(reps).select(*CLS, "n", "bits_1", "bits_2", hashed.alias("bands"))


def most_unlike(tau: float) -> float:
    """Different bits that a pair of similarity ``tau`` has at most: minima differ with probability 1 - similarity, and then in the lowest
    bit half the time."""
    p = (1 - tau) / 2
    return N_HASHES * p + 4 * (N_HASHES * p * (1 - p)) ** 0.5


def candidates(reps: DataFrame, tau: float, recall: float = 0.995, limit: int = LIMIT) -> DataFrame:
    """Pairs of different classes that share a band and pass the length and bit filters."""
    banded = bands(reps, tau, recall).select(*CLS, "n", "bits_1", "bits_2", F.explode("bands").alias("band"))
    pairs = self_pairs(banded, ["band"], CLS, ["n", "bits_1", "bits_2"], limit, rank=class_rank())
    n_1, n_2 = F.col("n_1"), F.col("n_2")
    unlike = F.bit_count(F.col("bits_1_1").bitwiseXOR(F.col("bits_1_2"))) + F.bit_count(F.col("bits_2_1").bitwiseXOR(F.col("bits_2_2")))
    near = pairs.where((n_2 >= tau * n_1 - EPS) & (n_2 <= n_1 / tau + EPS) & (unlike <= most_unlike(tau)))
    return near.select(*CLS_PAIR).distinct()


def pairs_at_least(reps: DataFrame, sets: DataFrame, tau: float, recall: float = 0.995, limit: int = LIMIT, shared: DataFrame | None = None, blocks: int = 0, keep: Callable[..., DataFrame] | None = None) -> DataFrame:
    """As ``similarity.pairs_at_least``, but for pairs that the bands miss: file pairs of different submissions with Jaccard >= tau."""
    if tau <= 0:
        raise ValueError("tau must be > 0")
    seats = class_seats(sets, reps)
    if blocks and shared is not None:
        banded = bands(reps, tau, recall).select(*CLS, "bits_1", "bits_2", F.col("bands").alias("probe"))
        found = tiles.file_pairs(shared.join(banded, CLS), seats, limit, tau, most_unlike(tau), blocks, keep)
    else:
        found = expand_class_pairs(verified(candidates(reps, tau, recall, limit), reps if shared is None else shared, tau), seats, limit)
    return positive_similarities(found.unionByName(within_class_pairs(seats, limit))).where(F.col("similarity") >= F.lit(tau))
