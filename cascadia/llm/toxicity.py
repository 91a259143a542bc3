"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its hashed word one-, two- and three-grams, of its pairs of
words with one or two words skipped, and of the stems (leading bytes) of its words, as
inflected and compound words share these; all are taken over the whole text. Follow-the-regularised-leader
learns with a rate for each coordinate; its L1 term leaves most weights at zero, and the
others, a few thousand, are broadcast as two sorted arrays. Scoring is one pass over the
texts without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import small_batches, table

U64 = np.uint64
#: Labelled rows to train on at most, those with the smallest hashes of doc_id.
MOST_LABELS = 5_000
#: A document is predicted toxic from this score.
TOXIC = 0.5
#: Places of the words of a feature after its first one.
GRAMS = ((), (1,), (1, 2), (2,), (3,))
#: Bytes of a word's stems.
STEMS = (4, 6)
#: Bits of a feature's hash.
BITS = 32
#: Passes over the sample.
PASSES = 6
#: Bits of the filter that most words' features don't pass.
FILTER = 18


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, row, feature) for runs of texts; a feature may repeat in a row."""
    for i, j, buf, off in K.text_chunks(texts):
        low = K.LOWER[buf]
        start, end, row = K.words(low, off, K.ALNUM)
        sums = K.prefix_hash(low)
        h = K.span_hash(sums, start, end)
        rows, found = [], []
        for kind, places in enumerate(GRAMS):
            n = len(h) - max(places, default=0)
            if n <= 0:
                continue
            x = K.mix(h[:n] + U64(kind + 1))
            for p in places:
                x = K.mix(x * U64(0xD6E8FEB86659FD93) + h[p : p + n])
            own = row[:n] == row[len(h) - n :]
            rows.append(row[:n][own])
            found.append(x[own] >> U64(64 - BITS))
        for kind, size in enumerate(STEMS, len(GRAMS)):
            own = end - start > size
            rows.append(row[own])
            found.append(K.mix(K.span_hash(sums, start[own], start[own] + size) + U64(kind + 1)) >> U64(64 - BITS))
        yield i, j, np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(found) if found else np.zeros(0, U64)


@dataclass
class Weights:
    """The features with a weight, sorted, and their weights."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float
    #: Score of a text without words.
    share: float

    def __post_init__(self) -> None:
        self.some = np.zeros(1 << FILTER, bool)
        self.some[(self.feature & U64((1 << FILTER) - 1)).astype(np.int64)] = True

    def score(self, texts: pa.Array) -> np.ndarray:
        out, words = np.full(len(texts), self.bias), np.zeros(len(texts), bool)
        for i, j, row, f in features(texts):
            words[i + row] = True
            near = self.some[(f & U64((1 << FILTER) - 1)).astype(np.int64)]
            row, f = row[near], f[near]
            at = np.minimum(np.searchsorted(self.feature, f), max(0, len(self.feature) - 1))
            hit = self.feature[at] == f if len(self.feature) else np.zeros(0, bool)
            pair = np.unique(row[hit] * np.int64(len(self.feature)) + at[hit])  # each feature counts once
            if len(pair):
                out[i:j] += np.bincount(pair // len(self.feature), self.weight[pair % len(self.feature)], j - i)
        return np.where(words, 1 / (1 + np.exp(-np.clip(out, -500, 500))), self.share)


def ftrl(docs: list[np.ndarray], y: np.ndarray, size: int, passes: int = PASSES, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights of ``size`` coordinates and the bias: FTRL-proximal over documents, sets of coordinates, in their order.

    The last coordinate of the state is the bias, which has no L1 term.
    """
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    thrift = np.full(size + 1, l1)
    thrift[size] = 0

    def weights(zi: np.ndarray, ni: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= t, 0.0, -(zi - np.sign(zi) * t) / ((beta + np.sqrt(ni)) / alpha + l2))

    own = [np.append(d, size) for d in docs]
    for _ in range(passes):
        for d, label in zip(own, y, strict=True):
            zi, ni = z[d], n[d]
            w = weights(zi, ni, thrift[d])
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[d] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[d] = ni + g * g
    w = weights(z, n, thrift)
    return w[:-1], float(w[-1])


def held_out(folds: int = 5, fold: int = 0) -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds) == fold


def learn_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Weights:
    """Weights from at most ``most`` labelled documents outside the held-out fold."""
    sample = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out())
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: list[bytes] = []
            for i, j, row, f in features(b.column(2)):
                pair = np.unique((row.astype(U64) << U64(BITS)) | f)
                at = np.searchsorted(pair >> U64(BITS), np.arange(j - i + 1, dtype=U64))
                sets += [(pair[p:q] & U64((1 << BITS) - 1)).astype(np.uint32).tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["doc_id", "y", "f"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, f binary").toPandas()
    found = sorted(zip(rows["doc_id"], rows["y"], rows["f"], strict=True))  # the weights don't depend on the order of rows
    order = np.argsort([hashlib.blake2b(b"%d %d" % x[:2], digest_size=8).digest() for x in found], kind="stable")
    found = [found[k] for k in order]
    return train([np.frombuffer(x[2], np.uint32) for x in found], np.array([float(x[1] > 0) for x in found]))


def train(docs: list[np.ndarray], y: np.ndarray) -> Weights:
    """Weights from sets of features; those of one document only, which say nothing of others, are left out."""
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Weights(np.zeros(0, U64), np.zeros(0), float(np.log(share / (1 - share))), share)
    every = np.sort(np.concatenate(docs))
    known = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    own = []
    for d in docs:
        at = np.minimum(np.searchsorted(known, d), max(0, len(known) - 1))
        own.append(at[known[at] == d] if len(known) else np.zeros(0, np.int64))
    w, bias = ftrl(own, y, len(known))
    some = np.flatnonzero(w)
    return Weights(known[some].astype(U64), w[some], bias, share)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """Score each document: doc_id, held_out, score, predicted (1 from a score of 0.5).

    Labels are learned from at most ``most`` labelled rows whose crc32(doc_id) mod 5
    is not 0; the inputs of a score are the words of the whole text alone. Null texts and
    those without words have the smoothed share of toxic labels; repeated rows are scored
    each; labels that are null or without a document are left out; repeated labels
    count each; without labels every score is 0.5, with those of one kind only it is
    their smoothed share; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(learn_toxicity(docs, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(known.value.score(b.column(1)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
