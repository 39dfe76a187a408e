"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs of the whole training part are quantised to levels of a base ``base`` logarithm; an n-gram of level q
is entered q times, as (n-gram, 1) .. (n-gram, q).  A count is read by probing level after level until one is missing,
which gives the level's mean count.  The filter is made of segments, small Bloom filters of their own: an n-gram's hash names its segment,
so each segment is built by one group of the shuffle from about ``per_segment`` occurrences, and their number grows with
the corpus.  It holds every word and every pair.  Up to ``max_bytes`` it is broadcast whole to the
workers; beyond that it stays in its stored table: the texts are cut into chunks, a chunk's distinct words and pairs go as one
row to each segment's group, are probed there, and their levels come back to the chunk.  Both ways read the same segments, so
they give the same scores.  A pair is no more frequent than its words, so its probes end at the lower of their levels.

P(w | v) = weight * c(v, w) / c(v) + (1 - weight) * (c(w) + 0.5) / (N + 0.5 (V + 1)), with the counts read from the filter.  The weight is
the one of ``WEIGHTS`` under which the training part is likeliest when each of its tokens is left out of the counts that predict it, over
all training tokens; texts are scored under every weight in one pass, and the best one's column stays.

The exact base score needs exact counts: the ``frequent`` most frequent words are sent to the workers (a bounded table), all other
words of a document are joined with the count table, where none of them is hot.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` of the A-Z-lower-cased text, then one end token.  Training documents are those whose
crc32(doc_id as text) mod ``folds`` is not 1; a missing doc_id counts as an empty text.

Defined results: null and empty texts are the end token alone; repeated rows are scored (and learnt) each;
with no training document every count is zero; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

U = np.uint64
#: Texts are worked on in chunks of this many bytes.
CHUNK = 2 << 20
#: A task sends on its pair counts when it holds this many.
HELD = 1_000_000
PROBES = 5
#: The highest level read.
MOST = 128
BITS = 10
#: Hash of what stands before the first word of a text.
START = 0x9E3779B97F4A7C15
#: The weights of a pair's own frequency that are tried.
WEIGHTS = (0.05, 0.15, 0.25, 0.35, 0.5, 0.7, 0.9)


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds`` = 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * U(0xD6E8FEB86659FD93) + second)


def chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(number of the first text, the texts) by chunks of ``CHUNK`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, done = 0, 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, done + CHUNK)) + 1)
        yield first, texts[first:last]
        first, done = last, int(ends[min(last, len(texts)) - 1])


class Tokens:
    """The tokens of some texts: numbers of the distinct ones by occurrence, in each text the end token last, whose number is that of
    the distinct words."""

    def __init__(self, texts: pa.Array):
        # both functions know A-Z, \x20 and \x09-\x0D only
        trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = pc.ascii_split_whitespace(trimmed)
        empty = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)  # which is split into one empty word
        self.sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64) - empty + 1
        found = words.flatten()
        if empty.any():
            found = found.filter(pc.not_equal(found, ""))
        found = found.dictionary_encode()
        n, flat = len(found), found.indices.to_numpy()
        self.words = found.dictionary
        self.distinct = self.words.cast(pa.binary()).to_pylist()
        self.ends = np.cumsum(self.sizes) - 1
        self.ids = np.full(n + len(texts), len(self.distinct), np.int64)
        inner = np.ones(len(self.ids), bool)
        inner[self.ends] = False
        self.ids[inner] = flat
        #: the end token hashes as a blank, which no word can be
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in [*self.distinct, b" "]), np.uint64, len(self.distinct) + 1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs, as numbers of the token before (one more than the end token's at a text's first) and of the token, and the place
        among them of every occurrence."""
        before = np.roll(self.ids, 1)
        before[self.ends - self.sizes + 1] = start = len(self.distinct) + 1
        codes = pa.array(before * (start + 1) + self.ids).dictionary_encode()
        first, second = np.divmod(codes.dictionary.to_numpy(), start + 1)
        return first, second, codes.indices.to_numpy()

    def pair_hashes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return pair_hashes(np.append(self.hashes, U(START))[first], self.hashes[second])


def word_counts(train: DataFrame) -> DataFrame:
    """(token, n): exact counts of all words of ``train``'s texts, without the end token."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for cell in b.column(0).cast(pa.binary()):
                counts.update((cell.as_py() or b"").lower().split())
                if len(counts) > 400_000:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return train.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment, which never falls as the hash grows."""
    return ((hashes >> U(48)) * U(segments) >> U(16)).astype(np.int64)


def _parcels(hashes: np.ndarray, counts: np.ndarray, kind: int, segments: int) -> pa.RecordBatch:
    """One row per segment: the hashes' low six bytes and the counts, added up where a hash repeats."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else order
    hashes, counts = hashes[heads], (np.add.reduceat(counts, heads) if len(heads) else counts).astype("<u4")
    seg = segment_of(hashes, segments)
    starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else order
    ends = np.append(starts[1:], len(seg))
    low = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    cells = [[x[i:j].tobytes() for i, j in zip(starts.tolist(), ends.tolist())] for x in (low, counts)]
    return pa.RecordBatch.from_arrays([pa.array(seg[starts]), pa.array([kind] * len(starts), pa.int32()), *(pa.array(c, pa.binary()) for c in cells)], ["seg", "kind", "hashes", "counts"])


PARCEL = "seg long, kind int, hashes binary, counts binary"


def pair_parcels(train: DataFrame, segments: int) -> DataFrame:
    """Counts of word pairs, summed within a chunk, in parcels by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            got = _parcels(*(np.concatenate(x) for x in zip(*held)), 2, segments)
            held.clear()
            return got

        for b in batches:
            for _, texts in chunks(b.column(0)):
                t = Tokens(texts)
                first, second, place = t.pairs()
                held.append((t.pair_hashes(first, second), np.bincount(place)))
                if sum(len(h) for h, _ in held) > HELD:
                    yield out()
        if held:
            yield out()

    return train.select("text").mapInArrow(run, PARCEL)


def word_parcels(counts: DataFrame, documents: int, segments: int) -> DataFrame:
    """The counts of words, of the end token and of the start, in parcels by segment."""
    spark = counts.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = np.fromiter((xxhash.xxh64_intdigest(t.as_py()) for t in b.column(0)), np.uint64, b.num_rows)
            yield _parcels(word_key(hashes), np.minimum(b.column(1).to_numpy(), 2**32 - 1), 1, segments)

    marks = spark.createDataFrame([(" ", documents)], "token string, n long")
    return counts.unionByName(marks).mapInArrow(run, PARCEL)


def word_key(hashes: np.ndarray) -> np.ndarray:
    """What a word's own count is filed under."""
    return mix(hashes ^ U(0xA5A5A5A5A5A5A5A5))


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    """0 for 0, else 1 + the whole part of log_base(count)."""
    return np.where(counts > 0, np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9).astype(np.int64) + 1, 0)


def level_means(base: float, most: int = MOST) -> np.ndarray:
    """The mean whole count of levels 0 .. most."""
    out = [0.0]
    for q in range(1, most + 1):
        lo = math.ceil(base ** (q - 1) - 1e-6)
        hi = max(lo, math.ceil(base ** q - 1e-6) - 1)
        out.append((lo + hi) / 2)
    return np.array(out)


def _places(low: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of (n-gram, level) start and how far apart they are, of 2**64."""
    x = mix(low + U(level * 0x9E3779B97F4A7C15 % 2**64))
    return x, x * U(0xD6E8FEB86659FD93) | U(1)


def _bit(x: np.ndarray, bits) -> np.ndarray:
    """The place x, of 2**64, among ``bits`` < 2**32 bits."""
    return ((x >> U(32)) * bits >> U(32)).astype(np.int64)


def _low(raw: bytes) -> np.ndarray:
    """Hashes from their low six bytes."""
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return np.concatenate([six, np.zeros((len(six), 2), np.uint8)], axis=1).view("<u8").ravel().astype(np.uint64)


def _segment(kinds: list[int], hashes: list[bytes], counts: list[bytes], base: float) -> bytes:
    """The bits of one segment from all its parcels."""
    low, total = [], []
    for kind in (1, 2):
        picked = [i for i, k in enumerate(kinds) if k == kind]
        if not picked:
            continue
        h = _low(b"".join(hashes[i] for i in picked))
        n = np.frombuffer(b"".join(counts[i] for i in picked), "<u4").astype(np.int64)
        order = np.argsort(h)
        h, n = h[order], n[order]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        low.append(h[heads])
        total.append(np.add.reduceat(n, heads))
    low, total = (np.concatenate(x) for x in (low, total))
    q = levels(total, base)
    bits = max(64, int(q.sum()) * BITS)
    out = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        x, step = _places(low[q >= level], level)
        for _ in range(PROBES):
            out[_bit(x, U(bits))] = True
            x = x + step
    return np.uint32(bits).tobytes() + np.packbits(out).tobytes()


def _segments(base: float):
    def run(key, table):
        cols = [table.column(c).to_pylist() for c in ("kind", "hashes", "counts")]
        return pa.table({"seg": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([_segment(*cols, base)], pa.binary())})

    return run


class LogFrequencyFilter:
    """The segments in a row, as sent to the workers.  ``segments`` gives (number, data); ``size`` is at least their bytes."""

    def __init__(self, segments: Iterable[tuple[int, bytes]], n: int, size: int):
        self.n = n
        self.bits, self.start = np.full(n, 64, np.uint64), np.zeros(n, np.int64)
        self.data = np.zeros(size + 8, np.uint8)  # a segment without entries reads the first eight bytes
        at = 8
        for s, data in segments:
            self.bits[s], self.start[s] = np.frombuffer(data[:4], np.uint32)[0], at
            self.data[at:at + len(data) - 4] = np.frombuffer(data, np.uint8, offset=4)
            at += len(data) - 4

    def levels(self, hashes: np.ndarray, most: np.ndarray | None = None, least: np.ndarray | None = None) -> np.ndarray:
        """Level after level is probed for those that had all levels before, from the one after ``least``, which are known, to ``most``."""
        most = np.full(len(hashes), MOST) if most is None else most
        level = np.zeros(len(hashes), np.int64) if least is None else np.minimum(least, most)
        seg = segment_of(hashes, self.n)
        # segment by segment, as what lies together is read faster; by the level that is known
        order = np.argsort(seg.astype(np.uint16), kind="stable") if self.n <= 1 << 16 else np.argsort(seg, kind="stable")
        order = order[np.argsort(level[order].astype(np.uint8), kind="stable")]
        ends = np.cumsum(np.bincount(level, minlength=1)).tolist()
        low, bits_of, start_of = hashes & U((1 << 48) - 1), self.bits[seg], self.start[seg]
        q, live = 1, order[:0]
        while q <= len(ends) or len(live):
            if q <= len(ends):
                live = np.concatenate([live, order[ends[q - 2] if q > 1 else 0:ends[q - 1]]])
            live = live[most[live] >= q]
            x, step = _places(low[live], q)
            bits, start = bits_of[live], start_of[live]
            for _ in range(PROBES):
                at = _bit(x, bits)
                hit = np.flatnonzero(self.data[start + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8) & 1)
                live, x, step, bits, start = live[hit], x[hit] + step[hit], step[hit], bits[hit], start[hit]
            level[live] = q
            q += 1
        return level


def build(train: DataFrame, counts: DataFrame, documents: int, segments: int, base: float) -> DataFrame:
    """(seg, data): the filter over all n-grams of ``train``, stored."""
    parcels = pair_parcels(train, segments).unionByName(word_parcels(counts, documents, segments))
    return stored(parcels.groupBy("seg").applyInArrow(_segments(base), "seg long, data binary"))


def cut(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of each row and of its chunk of about ``CHUNK`` bytes, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = chunk = TaskContext.get().partitionId() << 40
        size = 0
        for b in batches:
            at = []
            for n in pc.fill_null(pc.binary_length(b.column(2)), 0).to_pylist():
                at.append(chunk)
                size += n
                if size >= CHUNK:
                    chunk, size = chunk + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.arange(uid, uid + b.num_rows)), *b.columns], ["chunk", "uid", "doc_id", "held_out", "text"])
            uid += b.num_rows

    return stored(docs.select("doc_id", "held_out", "text").mapInArrow(run, "chunk long, uid long, doc_id long, held_out boolean, text string"))


def _asked(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the words in ``t.hashes`` and of the distinct pairs."""
    return word_key(t.hashes), t.pair_hashes(*t.pairs()[:2])


def _whole(table: pa.Table) -> pa.Array:
    """The texts of a chunk."""
    texts = table.column("text").combine_chunks()
    return texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts


def _answers(segment: LogFrequencyFilter, asked: list[bytes]) -> pa.Array:
    """The levels of the hashes of each row.  Rows are as many as chunks and short, as a chunk's hashes are spread over all segments: they
    are probed at once, and what several chunks ask once."""
    low, place = np.unique(_low(b"".join(asked)), return_inverse=True)
    level = segment.levels(low).astype(np.uint8)[place].tobytes()
    ends = np.cumsum([len(h) // 6 for h in asked]).tolist()
    return pa.array([level[i:j] for i, j in zip([0, *ends], ends)], pa.binary())


def segment_levels(pieces: DataFrame, grams: DataFrame, segments: int, base: float) -> DataFrame:
    """(chunk, seg, words, pairs): levels of the distinct words and pairs of each chunk that lie in the segment, in the order of ``_asked``."""

    def ask(key, table):
        keys = _asked(Tokens(_whole(table)))
        seg = [segment_of(k, segments) for k in keys]
        present = np.unique(np.concatenate(seg))
        cols = []
        for k, s in zip(keys, seg):
            order = np.argsort(s, kind="stable")
            low = np.ascontiguousarray(k[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            ends = np.searchsorted(s[order], present, "right")
            cols.append(pa.array([low[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)], pa.binary()))
        return pa.table([pa.array([key[0].as_py()] * len(present), pa.int64()), pa.array(present.astype(np.int64)), *cols], names=["chunk", "seg", "words", "pairs"])

    def answer(key, asked, made):
        data = [(0, d.as_py()) for d in made.column("data")]
        one = LogFrequencyFilter(data, 1, sum(len(d) for _, d in data))
        out = [_answers(one, asked.column(c).to_pylist()) for c in ("words", "pairs")]
        return pa.table([asked.column("chunk"), asked.column("seg"), *out], names=["chunk", "seg", "words", "pairs"])

    schema = "chunk long, seg long, words binary, pairs binary"
    probes = pieces.groupBy("chunk").applyInArrow(ask, schema)
    return probes.groupBy("seg").cogroup(grams.groupBy("seg")).applyInArrow(answer, schema)


def _tallies(words: pa.Array | None, texts: np.ndarray, ids: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """For each of ``n`` texts the distinct words among ``ids``, and how often each is."""
    words = pa.array([], pa.string()) if words is None else words
    width = len(words) + 1
    found, counts = np.unique(texts * width + ids, return_counts=True)
    offsets = pa.array(np.searchsorted(found // width, np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, words.take(pa.array(found % width))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))


def scores(docs: DataFrame, folds: int = 5, weight: float | None = None, base: float = 1.5, frequent: int = 200_000, per_segment: int = 1_500_000, max_bytes: int = 128 << 20) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  ``weight`` None: the best of ``WEIGHTS``."""
    spark = docs.sparkSession
    weights = np.array(WEIGHTS if weight is None else [weight])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id"), folds))
    train = docs.where("NOT held_out")
    counts = stored(word_counts(train))
    documents = train.count()
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (sums.n or 0) + documents, sums.v + (documents > 0)
    common = {r.token.encode(): r.n for r in counts.orderBy(F.desc("n"), "token").limit(frequent).toLocalIterator()}
    segments = max(1, -(-total // per_segment))
    grams = build(train, counts, documents, segments, base)
    size = grams.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    least, whole = 0.5, total + 0.5 * (distinct + 1)
    means = level_means(base)

    def rows(ids, b, pieces, common, lookup) -> pa.RecordBatch:
        """The rows of ``b``, whose texts come in ``pieces``; ``lookup`` gives the filter's levels of a piece's words and distinct pairs."""
        n = b.num_rows
        size, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
        exact, score, left_out = np.zeros(n), np.zeros((n, len(weights))), np.zeros((n, len(weights)))
        trained = ~b.column("held_out").to_numpy(zero_copy_only=False)
        rare = [_tallies(None, np.zeros(0, np.int64), np.zeros(0, np.int64), 0)]
        for at, texts in pieces:
            t = Tokens(texts)
            here = slice(at, at + len(texts))
            starts = t.ends - t.sizes + 1
            size[here] = t.sizes
            # exact counts; -1 where only the count table knows
            c = np.fromiter((common.get(w, -1) for w in t.distinct), np.float64, len(t.distinct))
            c = np.append(c, documents)
            known[here] = np.add.reduceat((c > 0).astype(np.int64)[t.ids], starts)
            exact[here] = np.add.reduceat(np.where(c >= 0, np.log10(np.maximum(c, 0) + least), 0.0)[t.ids], starts)
            unsure = np.flatnonzero((c < 0)[t.ids])
            rare.append(_tallies(t.words, np.searchsorted(t.ends, unsure), t.ids[unsure], len(texts)))
            # the model, pair by pair
            first, second, place = t.pairs()
            mine = np.repeat(trained[here], t.sizes).astype(np.float64)
            times = np.bincount(place, mine, len(first))
            words, both = lookup(t, first, second, np.maximum(c, np.bincount(t.ids, mine, len(t.hashes))), times)
            words = np.append(means[words], documents)  # a text's start is as frequent as documents
            context, own, both = words[first], words[second], means[both]
            both = np.minimum(both, np.minimum(context, own))
            share, alone = np.minimum(1.0, both / np.maximum(context, 1)), (own + least) / whole
            # each training token left out of its counts: pairs seen once are unseen then
            once, more = np.flatnonzero((times > 0) & (both <= 1)), np.flatnonzero((times > 0) & (both > 1))
            rest = (np.maximum(own - 1, 0) + least) / (whole - 1)
            unseen, n_once = np.dot(np.log10(rest[once]), times[once]), times[once].sum()
            share_left, rest, times = np.minimum(1.0, (both[more] - 1) / np.maximum(context[more] - 1, 1)), rest[more], times[more]
            for k, w in enumerate(weights.tolist()):
                score[here, k] = np.add.reduceat(np.log10(alone + w * (share - alone))[place], starts)
                left_out[at, k] += unseen + n_once * math.log10(1 - w) + np.dot(np.log10(rest + w * (share_left - rest)), times)
        pa.default_memory_pool().release_unused()
        words, times = (pa.concat_arrays(x) for x in zip(*rare))
        cells = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(weights)).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([ids, b.column("doc_id"), b.column("held_out"), pa.array(size), pa.array(known), pa.array(exact), cells(score), cells(left_out), words, times], ["uid", "doc_id", "held_out", "n_tokens", "known", "exact", "score", "left_out", "rare", "times"])

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, exact double, score array<double>, left_out array<double>, rare array<string>, times array<long>"
    if size <= max_bytes:
        # collected to be broadcast: at most max_bytes
        sent = spark.sparkContext.broadcast((LogFrequencyFilter(((r["seg"], r["data"]) for r in grams.toLocalIterator()), segments, size), common))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams, common = sent.value

            def lookup(t, first, second, n_words, n_pairs):
                # filed as often at least: the exact counts of the frequent words, what a chunk's training texts hold
                words = grams.levels(word_key(t.hashes), least=levels(n_words, base))
                most = np.append(words, MOST)
                most = np.minimum(most[first], most[second])
                both = np.zeros(len(first), np.int64)
                asked = np.flatnonzero(most)
                both[asked] = grams.levels(t.pair_hashes(first[asked], second[asked]), most[asked], levels(n_pairs[asked], base))
                return words, both

            uid = TaskContext.get().partitionId() << 40
            for b in batches:
                yield rows(pa.array(np.arange(uid, uid + b.num_rows)), b, chunks(b.column("text")), common, lookup)
                uid += b.num_rows

        made = docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)
    else:
        sent = spark.sparkContext.broadcast(common)

        def gather(key, table, answers):
            def lookup(t, first, second, n_words, n_pairs):
                out = []
                for keys, column in zip((word_key(t.hashes), t.pair_hashes(first, second)), ("words", "pairs")):
                    seg, level = segment_of(keys, segments), np.zeros(len(keys), np.int64)
                    order, parts = np.argsort(seg, kind="stable"), dict(zip(answers.column("seg").to_pylist(), answers.column(column).to_pylist()))
                    level[order] = np.frombuffer(b"".join(parts[s] for s in sorted(parts)), np.uint8)
                    out.append(level)
                return out

            table = table.combine_chunks()
            return pa.Table.from_batches([rows(table.column("uid").combine_chunks(), table.to_batches()[0], [(0, _whole(table))], sent.value, lookup)])

        pieces = cut(docs)
        made = pieces.groupBy("chunk").cogroup(segment_levels(pieces, grams, segments, base).groupBy("chunk")).applyInArrow(gather, schema)
    made = stored(made)
    best = 0
    if len(weights) > 1:
        fits = made.agg(*(F.sum(F.get("left_out", F.lit(k))) for k in range(len(weights)))).first()
        best = max(range(len(weights)), key=lambda k: (fits[k] or 0.0, -k))
    rest = made.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    rest = rest.join(counts, "token", "left").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + least)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found"))
    out = made.drop("rare", "times").join(rest, "uid", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("exact") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * math.log10(whole)).alias("base_score"), F.get("score", F.lit(best)).alias("score"))
