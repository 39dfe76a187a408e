"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence has probability p = sigmoid(bias + sum of its words' weights) and the document is toxic
by noisy-or, 1 - prod(1 - p).  Only document labels are learnt from: the gradient of the noisy-or likelihood
gives each sentence of a toxic document its share of the blame.  A word's weight is the sum over its features, the word itself and its
first 3 to 6 letters, so inflected forms share weight.  The same p then locates the offending sentences.

The model is fitted on a bounded sample, at most ``sample`` labelled documents of each class by hash order (whole texts, together
at most ``SAMPLE_BYTES`` a class or one text; texts over a 64th of that come last), weighted
back to the classes' shares; features seen in fewer than ``least`` sampled documents are not used.  Everything else covers all rows.

Rows are learnt from if crc32(doc_id as text) mod ``folds`` is not 1.  Scores use the text alone.

Defined results: null and empty texts have no sentence and score 0; repeated rows get equal scores, and of a doc_id's rows the smallest text is learnt from; rows without doc_id are
scored and never learnt from; without any labelled row, or with one class only, every score is that class's share (0 without labels) for texts that have words;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
SIZE = 1 << 20
#: Bytes of text that the sample may hold of each class.
SAMPLE_BYTES = 128 << 20


def features(word: str) -> list[int]:
    """Hashed: the word, and its first 3 to 6 letters."""
    return [crc32(word.encode()) % SIZE, *(crc32(b"%d*" % k + word[:k].encode()) % SIZE for k in (3, 4, 5, 6) if len(word) >= k)]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each sentence that has a word."""
    out = []
    for m in SENTENCE.finditer(text):
        if words := WORD.findall(m.group().lower()):
            out.append((m.start(), m.end(), words))
    return out


class Model:
    def __init__(self, bias: float, weights: np.ndarray, prior: float | None = None):
        self.bias, self.weights, self.prior = bias, weights, prior


def fit(texts: list[str], labels: np.ndarray, share: np.ndarray, least: int = 8, rounds: int = 500, rate: float = 0.6, sparse: float = 1.0, settle: int = 150) -> Model:
    """Noisy-or likelihood by full-batch Adagrad steps, each followed by a shrinking step: a feature keeps weight
    only against the pull of ``sparse`` documents, else it would learn single documents by heart.  After ``settle``
    rounds only features that have weight go on."""
    number: dict[str, int] = {}
    hashed: dict[str, list[int]] = {}
    words, at, doc = array("i"), array("i"), array("i")
    seen = np.zeros(SIZE, np.int32)
    for d, text in enumerate(texts):
        own = set()
        for _, _, ws in sentences(text):
            words.extend([number.setdefault(w, len(number)) for w in ws])
            at.extend([len(doc)] * len(ws))
            doc.append(d)
            own.update(ws)
        if own:
            for w in own:
                if w not in hashed:
                    hashed[w] = features(w)
            seen[np.unique([f for w in own for f in hashed[w]])] += 1
    words, at, doc = (np.frombuffer(x, np.int32) for x in (words, at, doc))
    n = len(doc)
    rows, cols = array("i"), array("i")
    for w, i in number.items():
        for f in hashed[w]:
            if seen[f] >= least:
                rows.append(i)
                cols.append(f)
    rows = np.frombuffer(rows, np.int32)
    used, cols = np.unique(np.frombuffer(cols, np.int32), return_inverse=True)
    # only words with a feature count
    known = np.zeros(len(number), bool)
    known[rows] = True
    words, at = words[known[words]], at[known[words]]
    pull = sparse / len(texts)
    share = share / share.sum()
    theta, bias = np.zeros(len(used)), -4.0
    size, bias_size = np.full(len(used), 1e-8), 1e-8
    for done in range(rounds):
        if done == settle:
            live = theta != 0
            kept = live[cols]
            rows, cols = rows[kept], (np.cumsum(live) - 1)[cols[kept]]
            used, theta, size = used[live], theta[live], size[live]
            known = np.zeros(len(number), bool)
            known[rows] = True
            words, at = words[known[words]], at[known[words]]
        u = np.bincount(rows, theta[cols], len(number))
        s = np.clip(bias + np.bincount(at, u[words], n), -30, 30)
        p = 1 / (1 + np.exp(-s))
        # log(1 - P) of the document is the sum of log(1 - p)
        rest = np.bincount(doc, np.log1p(-p), len(texts))
        blame = np.where(labels == 1, np.exp(rest) / np.maximum(-np.expm1(rest), 1e-12), -1.0) * share
        g = blame[doc] * p
        step = np.bincount(cols, np.bincount(words, g[at], len(number))[rows], len(used))
        size += step * step
        pace = rate / np.sqrt(size)
        theta += pace * step
        theta = np.sign(theta) * np.maximum(np.abs(theta) - pace * pull, 0)
        b = g.sum()
        bias_size += b * b
        bias += rate * b / math.sqrt(bias_size)
    weights = np.zeros(SIZE, np.float32)
    weights[used] = theta
    return Model(float(bias), weights)


def labelled(docs: DataFrame, labels: DataFrame, folds: int, sample: int, most: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of the sample: at most 2 * ``sample`` documents, each doc_id once, of ``most`` bytes a class."""
    part = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    part = part.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 1)
    part = part.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # of contradicting labels, toxic holds
    sizes = {r["toxic"]: r["n"] for r in part.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    picked = [part.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    order = Window.partitionBy("toxic").orderBy(size > most // 64, F.xxhash64("doc_id"), "doc_id")  # at most ``sample`` rows a class
    rows = rows.withColumn("_bytes", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(order))
    rows = rows.where((F.col("_bytes") <= most) | (F.col("_nth") == 1)).select("doc_id", "text", "toxic").collect()  # bounded by ``sample`` and ``most``
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    y = np.array([r["toxic"] for r in rows], np.int64)
    got = np.bincount(y, minlength=2)
    share = np.array([sizes.get(c, 0) / max(1, got[c]) for c in (0, 1)])
    return [r["text"] or "" for r in rows], y, share[y] if len(y) else np.zeros(0)


def trained(docs: DataFrame, labels: DataFrame, folds: int = 3, sample: int = 4000) -> Model:
    texts, y, share = labelled(docs, labels, folds, sample)
    if len(set(y.tolist())) < 2:
        return Model(0.0, np.zeros(SIZE, np.float32), prior=float(y.mean()) if len(y) else 0.0)
    return fit(texts, y, share)


class _Weights(dict):
    """Summed weight of each word; forgets all at ``most`` words."""

    def __init__(self, weights: np.ndarray, most: int = 300_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        u = float(sum(self.weights[f] for f in features(word)))
        if len(self) >= self.most:
            self.clear()
        if len(word) < 64:
            self[word] = u
        return u


def judge(text: str, model: Model, known: dict[str, float]) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's score and (start, end, p) of its sentences."""
    found, rest = [], 0.0
    for start, end, words in sentences(text):
        s = max(-30.0, min(30.0, model.bias + sum(map(known.__getitem__, words))))
        p = 1 / (1 + math.exp(-s)) if model.prior is None else model.prior
        found.append((start, end, p))
        rest += math.log1p(-p) if p < 1 else -math.inf
    if model.prior is not None:
        return (model.prior if found else 0.0), found
    return -math.expm1(rest), found


def scored(docs: DataFrame, model: Model, offence: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id, score and offences, an array of (start, end, p) of the sentences with p >= ``offence``,
    in characters of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Weights(sent.value.weights)
        for b in batches:
            score, spans = [], []
            for cell in b.column(1):
                s, found = judge(cell.as_py() or "", sent.value, known)
                score.append(min(1.0, max(0.0, s)))
                spans.append([{"start": a, "end": z, "p": p} for a, z, p in found if p >= offence])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(spans, pa.list_(span))], ["doc_id", "score", "offences"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, offences array<struct<start:long,end:long,p:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, sample: int = 4000, threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, offences."""
    out = scored(docs, trained(docs, labels, folds, sample))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offences")
