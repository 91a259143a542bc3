"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's bytes, one in each direction, and a
softmax labels every position from both states. The network is trained here in
numpy by backpropagation through time. A document's distribution is the pooled
(geometric mean) distribution of all its positions. Texts are read whole, in
windows that overlap, so that every position is labelled in its context; a task
labels equal windows, as copies of a text have them, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import small_batches, table

U64 = np.uint64
#: Documents of each language to train on at most, those with the smallest hashes of doc_id.
MOST_DOCUMENTS = 150
#: Bytes that one window labels, and those that it reads besides on either side.
SPAN, CONTEXT = 112, 8
#: Windows that a task remembers before it starts anew.
MOST_WINDOWS = 1 << 18
#: Bytes of one window in training.
TRAIN_SPAN = 48


def windows(off: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of pieces of ``span`` bytes that cover each row."""
    n = -(-(off[1:] - off[:-1]) // span)
    row = np.repeat(np.arange(len(n)), n)
    s = off[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * span
    return s, np.minimum(s + span, off[row + 1]), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, of an array that is not used again."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Weights of both directions: input table w (256 x 3h), recurrent u (h x 3h), and the output layer."""

    def __init__(self, classes: list[str], hidden: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        self.p: dict[str, np.ndarray] = {"o": r.normal(0, 0.1, (2 * hidden, len(classes))), "ob": np.zeros(len(classes))}
        for d in "fb":
            self.p |= {f"w{d}": r.normal(0, 0.3, (256, 3 * hidden)), f"u{d}": r.normal(0, hidden**-0.5, (hidden, 3 * hidden)), f"c{d}": np.zeros(hidden)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _layer(self, x: np.ndarray, on: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States at each position and what gradients need; a gated unit with update, reset and candidate parts."""
        h, w, u, c = self.hidden, self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"c{d}"]
        n, t = x.shape
        state = np.zeros((n, h), w.dtype)
        out, tape = np.zeros((t, n, h), w.dtype), []
        full, at = on.all(0), np.ascontiguousarray(x.T)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a, b = w.take(at[i], 0), state @ u
            gates = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            pre = b[:, 2 * h :] + c
            g = np.tanh(a[:, 2 * h :] + r * pre)
            new = state - g
            new *= z
            new += g
            tape.append((i, state, z, r, pre, g))
            state = new if full[i] else np.where(on[:, i, None], new, state)
            out[i] = state
        return out, tape

    def _states(self, x: np.ndarray, on: np.ndarray, d: str) -> np.ndarray:
        """The states of ``_layer`` alone, in half its time: the three parts lie apart, so that all steps run over whole blocks.

        sigmoid(x) is 1 / (1 + exp(-x)) and tanh(x) is 1 - 2 / (1 + exp(2x)), as exp
        is the faster function; the weights carry these factors.
        """
        h, (n, t) = self.hidden, x.shape
        w, u = (self.p[f"{k}{d}"].reshape(-1, 3, h).transpose(1, 0, 2) for k in "wu")
        factor = np.array([-1, -1, 2], w.dtype)[:, None, None]
        w, u, c = np.ascontiguousarray(w * factor), np.ascontiguousarray(u * factor), np.tile(2 * self.p[f"c{d}"], (n, 1))
        state = np.zeros((n, h), w.dtype)
        out, a, b = np.empty((t, n, h), w.dtype), np.empty((3, n, h), w.dtype), np.empty((3, n, h), w.dtype)
        full, at = on.all(0), np.ascontiguousarray(x.T).astype(np.intp)
        gates, g, (z, r, pre) = b[:2], a[2], b
        with np.errstate(over="ignore"):  # exp may be infinite, its reciprocal is 0 then
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                w.take(at[i], 1, out=a, mode="clip")
                np.matmul(state, u, out=b)
                gates += a[:2]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                pre += c
                pre *= r
                g += pre
                np.exp(g, out=g)
                g += 1
                np.divide(-2, g, out=g)
                g += 1
                np.subtract(state, g, out=pre)
                pre *= z
                new = np.add(pre, g, out=out[i])
                if not full[i]:
                    np.copyto(new, state, where=~on[:, i, None])
                state = new
        return out

    def positions(self, x: np.ndarray, on: np.ndarray, keep: bool = False) -> tuple:
        """Log-probabilities of the classes at each position, (time, window, class)."""
        o, h = self.p["o"], self.hidden
        if keep:
            (f, tf), (b, tb) = self._layer(x, on, "f"), self._layer(x, on, "b")
            y = f @ o[:h] + b @ o[h:] + self.p["ob"]
        else:  # the positions of a class lie together
            y = o[:h].T @ self._states(x, on, "f").transpose(0, 2, 1)
            y += o[h:].T @ self._states(x, on, "b").transpose(0, 2, 1)
            y += self.p["ob"][:, None]
            y = y.transpose(0, 2, 1)
        # The few classes are worked through one by one: reductions over a short last axis are slow.
        k = range(y.shape[2])
        top = y[:, :, 0].copy()
        for c in k:
            np.maximum(top, y[:, :, c], out=top)
        y -= top[:, :, None]
        total = np.zeros_like(top)
        for c in k:
            total += np.exp(y[:, :, c])
        y -= np.log(total)[:, :, None]
        return (y, np.concatenate((f, b), 2), tf, tb) if keep else (y,)

    def gradients(self, x: np.ndarray, on: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients, by backpropagation through time."""
        y, s, tf, tb = self.positions(x, on, True)
        n, t = x.shape
        h = self.hidden
        m = on.T.astype(np.float32) / on.sum()
        loss = -(y[:, np.arange(n), label] * m).sum()
        dy = np.exp(y)
        dy[:, np.arange(n), label] -= 1
        dy *= m[:, :, None]
        g = {"o": np.einsum("tnh,tnk->hk", s, dy), "ob": dy.sum((0, 1))}
        ds = dy @ self.p["o"].T
        for d, tape, part in (("f", tf, ds[:, :, :h]), ("b", tb, ds[:, :, h:])):
            u = self.p[f"u{d}"]
            gw, gu, gc, carry = np.zeros_like(self.p[f"w{d}"]), np.zeros_like(u), np.zeros(h, np.float32), np.zeros((n, h), np.float32)
            for i, before, z, r, pre, cand in reversed(tape):
                live = on[:, i, None]
                total = carry + part[i]
                down = np.where(live, total, 0)
                dz = down * (before - cand) * z * (1 - z)
                dg = down * (1 - z) * (1 - cand**2)
                dr = dg * pre * r * (1 - r)
                da = np.concatenate((dz, dr, dg), 1)
                db = np.concatenate((dz, dr, dg * r), 1)
                np.add.at(gw, x[:, i], da)
                gu += before.T @ db
                gc += (dg * r).sum(0)
                carry = down * z + db @ u.T + np.where(live, 0, total)
            g |= {f"w{d}": gw, f"u{d}": gu, f"c{d}": gc}
        return float(loss), g


def pad(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in found])
    x = np.zeros((len(found), int(size.max())), np.uint8)
    for i, w in enumerate(found):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    return x, np.arange(x.shape[1]) < size[:, None]


def train(found: list[bytes], labels: np.ndarray, classes: list[str], steps: int = 600, batch: int = 96, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit the network to labelled windows by Adam, in batches of any windows."""
    net, r = Network(classes, seed=seed), np.random.default_rng(seed)
    if not found or len(classes) < 2:
        return net
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, steps + 1):
        pick = r.integers(0, len(found), batch)
        x, on = pad([found[i] for i in pick])
        _, g = net.gradients(x, on, labels[pick])
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, d in g.items():
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.01 * (d * d - v[k])
            net.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


class Labeller:
    """Sums of log-probabilities over the positions of windows, remembered by their hashes."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, U64)
        self.sums = np.zeros((0, len(self.net.classes)), np.float32)

    def rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, row) of all windows of the rows of ``data``."""
        s, e, row = windows(off, SPAN)
        lo, hi = np.maximum(s - CONTEXT, off[row]), np.minimum(e + CONTEXT, off[row + 1])
        c = K.prefix_hash(data)
        hashes = K.mix(K.span_hash(c, lo, hi) + (s - lo).astype(U64) * U64(256) + (hi - e).astype(U64))
        if len(self.keys) > MOST_WINDOWS:
            self.forget()
        u, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, u), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != u) if len(self.keys) else np.arange(len(u))
        if len(new):
            k = first[new]
            sums = self._label(data, lo[k], s[k], e[k], hi[k])
            where = np.searchsorted(self.keys, u[new])
            self.keys, self.sums = np.insert(self.keys, where, u[new]), np.insert(self.sums, where, sums, 0)
        return self.sums[np.searchsorted(self.keys, u)][back], row

    def _label(self, data: np.ndarray, lo: np.ndarray, s: np.ndarray, e: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.zeros((len(s), len(self.net.classes)), np.float32)
        order = np.argsort(hi - lo, kind="stable")
        for i in range(0, len(order), 2048):
            o = order[i : i + 2048]
            at = lo[o][:, None] + np.arange(int((hi[o] - lo[o]).max()))
            (y,) = self.net.positions(data[np.minimum(at, len(data) - 1)], at < hi[o][:, None])
            own = (at >= s[o][:, None]) & (at < e[o][:, None])
            out[o] = np.einsum("tnk,nt->nk", y, own.astype(np.float32))
        return out


def held_out(folds: int = 5, fold: int = 0) -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds) == fold


def learn_languages(docs: DataFrame, most: int = MOST_DOCUMENTS) -> Network:
    """A network from all windows of at most ``most`` documents of each language outside the held-out fold."""
    rows = docs.select("doc_id", "lang").where("lang is not null and doc_id is not null").where(~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("doc_id", F.col("lang").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for _, _, buf, off in K.text_chunks(b.column(1)):
                low = K.LOWER[buf]
                s, e, row = windows(off, TRAIN_SPAN)
                at = np.searchsorted(row, np.arange(len(off)))
                for i in range(len(off) - 1):
                    found.append([low[s[k] : e[k]].tobytes() for k in range(at[i], at[i + 1])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], names=["label", "windows"])

    # The distinct ids: a repeated doc_id must not multiply rows.
    few = few.groupBy("doc_id").agg(F.min("label").alias("label"))
    got = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("label", "text").mapInArrow(run, "label string, windows array<binary>").toPandas()
    classes = sorted(set(got["label"]))
    pairs = sorted((bytes(w), classes.index(x)) for x, ws in zip(got["label"], got["windows"], strict=True) for w in ws)
    return train([w for w, _ in pairs], np.array([k for _, k in pairs], np.int64), classes)


def languages(docs: DataFrame, most: int = MOST_DOCUMENTS) -> DataFrame:
    """Predict the language of each document: doc_id, held_out, lang_pred, score.

    The network learns from documents whose crc32(doc_id) mod 5 is not 0, at most
    ``most`` of each language; a prediction reads all bytes of the whole text, A-Z
    lower-cased, and nothing else. lang_pred is ``und`` with score 0 for a null text, one
    without a letter, or if there was nothing to learn from; score is the pooled
    probability. Ties go to the first language by name; repeated rows are
    predicted each; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(learn_languages(docs, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = known.value
        lab = Labeller(net)
        names = np.array([*net.classes, "und"], dtype=object)
        for b in batches:
            pred, score = [], []
            for i, j, buf, off in K.text_chunks(b.column(1)):
                n = j - i
                low = K.LOWER[buf]
                total, size = np.zeros((n, len(net.classes))), off[1:] - off[:-1]
                if len(low) and net.classes:
                    sums, row = lab.rows(low, off)
                    np.add.at(total, row, sums)
                mean = total / np.maximum(1, size)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True)) if net.classes else np.zeros((n, 1))
                p /= np.maximum(1e-30, p.sum(1, keepdims=True))
                best = p.argmax(1)
                ascii_ = np.zeros(len(low) + 1, np.int64)
                np.cumsum((low >= 97) & (low <= 122), out=ascii_[1:])
                none = ascii_[off[1:]] == ascii_[off[:-1]]
                for k in np.flatnonzero(none):  # the few texts without an ASCII letter
                    none[k] = not any(c.isalpha() for c in buf[off[k] : off[k + 1]].tobytes().decode(errors="ignore"))
                none |= not net.classes
                pred.extend(names[np.where(none, len(net.classes), best)])
                score.extend(np.where(none, 0.0, p[np.arange(n), best]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return languages(table(spark, sf_dir, "documents"))
