"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed for whole texts by numpy kernels inside Spark tasks.
Training reads a bounded sample of labelled rows; the trees are flattened into
arrays and a batch of documents descends all of them level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import filtered, small_batches, table

#: Labelled rows to train on at most, those with the smallest hashes of doc_id.
MOST_LABELS = 20_000
#: A document is predicted good from this score.
GOOD = 0.7

CLASSES = ["upper", "lower", "digit", "space", "newline", "high", "stop", "comma", "shout", "symbol", "bar", "bracket", "quote", "control"]
_CLASS = np.full(256, CLASSES.index("control"), np.uint8)
for _name, _bytes in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t"), ("newline", b"\n\r"), ("high", range(128, 256)), ("stop", b".?:;"), ("comma", b",-"), ("shout", b"!"), ("symbol", b"#$%&*+=@^~/\\_"), ("bar", b"|"), ("bracket", b"()[]{}<>"), ("quote", b"\"'`")):
    _CLASS[list(_bytes)] = CLASSES.index(_name)
STATISTICS = [*(f"share_{c}" for c in CLASSES), "log_bytes", "log_words", "words_a_line", "word_bytes", "word_spread", "long_words", "distinct_words", "top_word", "distinct_triples", "distinct_lines", "upper_words", "marked_words", "entropy"]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; null is empty, and an empty text has zeros."""
    out = [np.zeros((0, len(STATISTICS)), np.float32)]
    for i, j, buf, off in K.text_chunks(texts):
        n, size = j - i, np.diff(off)
        row = np.repeat(np.arange(n), size)
        kinds = np.bincount(row * len(CLASSES) + _CLASS[buf], minlength=n * len(CLASSES)).reshape(n, -1)
        share = kinds / np.maximum(1, size)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = -np.nansum(np.where(share > 0, share * np.log(share), 0), axis=1)
        s, e, of = K.words(buf, off, K.NOT_SPACE)
        h = K.span_hash(K.prefix_hash(K.LOWER[buf]), s, e) if len(s) else np.zeros(0, np.uint64)
        n_words = np.bincount(of, minlength=n)
        length = (e - s).astype(float)
        each = np.maximum(1, n_words)
        mean = np.bincount(of, length, n) / each
        spread = np.sqrt(np.maximum(0, np.bincount(of, length**2, n) / each - mean**2))
        first, last = _CLASS[buf[s]] if len(s) else s, _CLASS[buf[e - 1]] if len(s) else s
        odd = np.isin(last, [CLASSES.index(c) for c in ("shout", "symbol", "bar", "bracket")])
        second = _CLASS[buf[np.minimum(s + 1, e - 1)]] if len(s) else s
        shout = (first == 0) & (second == 0) & (e - s > 1)
        ls, le, lof = K.words(buf, off, np.arange(256) != 10)
        lh = K.span_hash(K.prefix_hash(buf), ls, le) if len(ls) else np.zeros(0, np.uint64)
        n_lines = np.bincount(lof, minlength=n)
        at, lat = np.searchsorted(of, np.arange(n + 1)), np.searchsorted(lof, np.arange(n + 1))
        triples = K.window_hashes(h, 3)
        distinct, top, three, lines = (np.zeros(n) for _ in range(4))
        for r in range(n):
            lo, hi = at[r], at[r + 1]
            if hi > lo:
                _, c = np.unique(h[lo:hi], return_counts=True)
                distinct[r], top[r] = len(c) / (hi - lo), c.max() / (hi - lo)
                three[r] = len(np.unique(triples[lo : hi - 2])) / (hi - lo - 2) if hi - lo > 2 else 1
                lines[r] = len(np.unique(lh[lat[r] : lat[r + 1]])) / max(1, lat[r + 1] - lat[r])
        cols = [np.log1p(size), np.log1p(n_words), n_words / np.maximum(1, n_lines), mean, spread, np.bincount(of, length > 24, n) / each, distinct, top, three, lines, np.bincount(of, shout, n) / each, np.bincount(of, odd, n) / each, entropy]
        out.append(np.concatenate((share, np.stack(cols, 1)), 1).astype(np.float32))
    return np.concatenate(out)


@dataclass
class Trees:
    """Trees as arrays: node i of tree t is left by ``x[feature] <= threshold`` to child[i], else child[i] + 1; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        n_trees, total = len(self.feature), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(n_trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f, child = self.feature[t][at], self.child[t][at]
                at = np.where(child == at, at, child + (x[rows, f] > self.threshold[t][at]))
            total += self.value[t][at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def train_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss over feature histograms."""
    nodes = 2 ** (depth + 1) - 1
    if not len(y) or y.min() == y.max():
        value = 0.0 if not len(y) else np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        z = np.zeros((0, nodes), np.int64)
        return Trees(z, z.astype(float), z, z.astype(float), float(value), depth)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(n, base)
    all_f, all_t, all_c, all_v = [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold, child, value = np.zeros(nodes, np.int64), np.zeros(nodes), np.arange(nodes), np.zeros(nodes)
        at = np.zeros(n, np.int64)
        for level in range(depth + 1):
            lo = 2**level - 1
            width_l = 2**level
            here = at - lo
            live = (here >= 0) & (here < width_l)
            k = here[live]
            gs, hs = np.bincount(k, g[live], width_l), np.bincount(k, h[live], width_l)
            value[lo : lo + width_l] = -rate * gs / (hs + ridge)
            if level == depth:
                break
            best, best_f, best_b = np.zeros(width_l), np.full(width_l, -1), np.zeros(width_l, np.int64)
            for f in range(width):
                if not len(edges[f]):
                    continue
                m = len(edges[f]) + 1
                key = k * m + binned[live, f]
                gl = np.bincount(key, g[live], width_l * m).reshape(width_l, m).cumsum(1)[:, :-1]
                hl = np.bincount(key, h[live], width_l * m).reshape(width_l, m).cumsum(1)[:, :-1]
                gr, hr = gs[:, None] - gl, hs[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs**2 / (hs + ridge))[:, None]
                gain[(hl < least / 4) | (hr < least / 4)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(width_l), b]
                win = top > best + 1e-9
                best, best_f, best_b = np.where(win, top, best), np.where(win, f, best_f), np.where(win, b, best_b)
            split = best_f >= 0
            for i in np.flatnonzero(split):
                feature[lo + i], threshold[lo + i], child[lo + i] = best_f[i], edges[best_f[i]][best_b[i]], 2 * (lo + i) + 1
            ok = live.copy()
            ok[live] = split[k]
            i = at[ok]
            at[ok] = child[i] + (x[ok, feature[i]] > threshold[i])
        raw += value[at]
        all_f.append(feature)
        all_t.append(threshold)
        all_c.append(child)
        all_v.append(value)
    return Trees(np.array(all_f), np.array(all_t), np.array(all_c), np.array(all_v), base, depth)


def held_out(folds: int = 4, fold: int = 2) -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds) == fold


def learn_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Trees:
    """Trees from at most ``most`` labelled documents outside the held-out fold."""
    sample = labels.select("doc_id", F.col("quality").alias("y")).where("doc_id is not null and y is not null").where(~held_out())
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["y", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("y").cast("int").alias("y"), "text").mapInArrow(run, "y int, x array<float>").toPandas()
    x = np.stack(rows["x"].tolist()).astype(np.float32) if len(rows) else np.zeros((0, len(STATISTICS)), np.float32)
    y = rows["y"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the model doesn't depend on the order of rows
    return train_trees(x[order], y[order])


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) for each document."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(known.value.score(statistics(b.column(1)).astype(np.float32)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """Score each document: doc_id, held_out, score, predicted (1 from a score of 0.7).

    Labels are learned from at most ``most`` labelled rows whose crc32(doc_id)
    mod 4 is not 2; the inputs of a score are statistics of the whole text alone.
    Null and empty texts are scored as empty; repeated rows are scored each;
    labels that are null or without a document are left out; with no labels at
    all every score is 0.5; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    scored = score_quality(docs, learn_quality(docs, labels, most))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """The documents, all their columns, that ``quality`` predicts as 1; with no labels at all every one stays."""
    small_batches(docs.sparkSession)
    model = learn_quality(docs, labels, most)
    if not len(model.feature) and model.base == 0:  # no labels, no decision
        return docs
    known = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda: lambda texts: known.value.score(statistics(texts).astype(np.float32)) >= GOOD)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
