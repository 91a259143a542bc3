"""Encoding and decoding with a vocabulary of scored pieces.

The best segmentation under a unigram model, the one with the greatest sum of
piece scores, is found by Viterbi over a double-array trie. Scores are log
probabilities, estimated from the documents themselves by rounds of expectation
and maximisation over their distinct words; the vocabulary file gives the pieces
only, since the scores of a merge model are ranks. No piece has a
whitespace marker behind another character, so the text falls apart into runs of
markers with the word behind them, which are segmented independently and
remembered by each task; many words advance through the trie in step.
Characters without a piece become byte pieces. Decoding turns markers into
spaces and drops the one that encoding puts in front.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, small_batches, table

MARK = "▁"
#: A vocabulary file; any SentencePiece model with byte pieces will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that a task remembers before it starts anew.
MOST_WORDS = 1 << 19
UNKNOWN = 10.0
#: Bytes from which a word is segmented alone, edge by edge, and not in step with others.
LONG = 1024
#: Bytes of a word up to which products of probabilities are summed, with this logarithm of a factor for each byte.
SHORT, LIFT = 32, 3.0
#: Least sum of such products that is trusted; words below it are summed as logarithms.
LEAST_SUM = 1e-200
#: Rounds of estimation at most, and the relative gain in likelihood below which they end.
MOST_ROUNDS = 40
LEAST_GAIN = 1e-4
#: Expected counts are summed as integers of this part, so that no order of tasks changes them.
QUANTUM = 2.0**-20


@dataclass
class DoubleArray:
    """A byte trie in two arrays: from s, byte b leads to t = base[s] + b + 1 if check[t] == s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    depth: int

    @classmethod
    def build(cls, keys: list[bytes], values: list[int]) -> DoubleArray:
        trie: list[dict[int, int]] = [{}]
        ends = {}
        for k, v in zip(keys, values, strict=True):
            s = 0
            for b in k:
                if b not in trie[s]:
                    trie[s][b] = len(trie)
                    trie.append({})
                s = trie[s][b]
            ends[s] = v
        size = 8 * len(trie) + 4096
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        free = wide = 1  # no slot before is free; no wide node fits before
        todo = [(0, 0)]
        for node, at in todo:
            if node in ends:
                value[at] = ends[node]
            codes = np.array(sorted(trie[node]), np.int64) + 1
            if not len(codes):
                continue
            while used[free]:
                free += 1
            if len(codes) == 1 and free >= codes[0]:
                b = free - int(codes[0])
            else:
                b = -1
                while b < 0:
                    slots = wide + np.flatnonzero(~used[wide : wide + 2048])
                    slots = slots[slots >= codes[0]] - codes[0]
                    fits = np.flatnonzero(~used[slots[:, None] + codes].any(1))
                    if len(fits):
                        b = int(slots[fits[0]])
                    if len(fits) == 0 or len(slots) < 200:
                        wide += 1024
            base[at] = b
            used[b + codes] = True
            check[b + codes] = at
            todo.extend((trie[node][int(c) - 1], b + int(c)) for c in codes)
        last = int(np.flatnonzero(used).max()) + 258
        return cls(base[:last], check[:last], value[:last], max(map(len, keys), default=0))


@dataclass
class Vocabulary:
    """Pieces as bytes, markers as spaces; ``byte_ids[b]`` is the piece of byte b."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    trie: DoubleArray
    cuts: str = field(default="")

    @classmethod
    def of(cls, pieces: list[tuple[str, float]], byte_ids: dict[int, int], special: set[int]) -> Vocabulary:
        """``byte_ids`` maps bytes to their pieces, all 256; ``special`` are pieces that stand for no text."""
        if set(byte_ids) != set(range(256)):
            raise ValueError("a piece for every byte is needed")
        of_byte = {v: k for k, v in byte_ids.items()}
        raw = [b"" if i in special else bytes([of_byte[i]]) if i in of_byte else p.replace(MARK, " ").encode() for i, (p, _) in enumerate(pieces)]
        plain = [i for i in range(len(pieces)) if i not in special and i not in of_byte and raw[i]]
        whole = any(re.search(f"[^{MARK}]{MARK}", pieces[i][0]) for i in plain)
        cuts = "" if whole else " " + "".join(c for c in "\n\t\r" if not any(c in pieces[i][0] for i in plain))
        ids = np.array([byte_ids[b] for b in range(256)], np.int32)
        return cls(raw, np.array([s for _, s in pieces]), ids, DoubleArray.build([raw[i] for i in plain], plain), cuts)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        return cls.of([(m.id_to_piece(i), m.get_score(i)) for i in range(n)], {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}, {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)})


class Encoder:
    """Encodes and decodes batches of texts; one for each task."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.unknown = min((v.scores[i] for i in v.trie.value[v.trie.value >= 0]), default=0.0) - UNKNOWN
        if v.cuts:
            rest = re.escape(v.cuts[1:])
            self.split = re.compile(f" +[^ {rest}{MARK}]*|[^ {rest}{MARK}]+|[{rest}{MARK}]").findall
        else:
            self.split = re.compile(f"[^{MARK}]+|{MARK}").findall
        sizes = np.array([len(p) for p in v.pieces])
        self.piece_at = np.concatenate(([0], np.cumsum(sizes)))
        self.piece_bytes = np.frombuffer(b"".join(v.pieces), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the pieces of text i are ids[offsets[i]:offsets[i + 1]]; null is empty."""
        if len(self.known) > MOST_WORDS:
            self.forget()
        known, new = self.known, []
        words, counts = [], []
        for t in texts:
            parts = self.split(" " + t) if t else []
            counts.append(len(parts))
            for w in parts:
                k = known.get(w)
                if k is None:
                    k = known[w] = len(known)
                    new.append(w)
                words.append(k)
        if new:
            ids, at = self.segment([w.encode() for w in new])
            self.ids = np.concatenate((self.ids, ids))
            self.at = np.concatenate((self.at, self.at[-1] + at[1:]))
        w = np.array(words, np.int64)
        size = (self.at[1:] - self.at[:-1])[w] if len(w) else w
        ends = np.cumsum(size)
        flat = self.ids[np.arange(ends[-1] if len(w) else 0) + np.repeat(self.at[w] - (ends - size), size)]
        return flat, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].astype(np.int64)

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi for many words in step: their ids, laid end to end, and offsets."""
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        found: list = [None] * 3
        rows, starts, pieces = [], [], []
        for o in order[size[order] >= LONG]:
            at, ids = self._alone(words[o])
            for x, y in zip((rows, starts, pieces), (np.full(len(at), o), at, ids), strict=True):
                x.append(y)
        order = order[size[order] < LONG]
        i = 0
        while i < len(order):
            j = min(len(order), i + 1 + (1 << 20) // (int(size[order[i]]) + 16))
            while j > i + 1 and size[order[j - 1]] > 2 * size[order[i]] + 8:
                j = i + (j - i) // 2
            for k, x in enumerate(self._batch([words[o] for o in order[i:j]])):
                (rows, starts, pieces)[k].append(order[i:j][x] if k == 0 else x)
            i = j
        found = [np.concatenate(x) for x in (rows, starts, pieces)]
        by = np.lexsort((found[1], found[0]))
        row = found[0][by]
        return found[2][by].astype(np.int32), np.searchsorted(row, np.arange(len(words) + 1))

    def _edges_of(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all edges of one word by start, -1 for characters without a piece; all starts walk the trie in step."""
        trie = self.v.trie
        text = np.frombuffer(word, np.uint8).astype(np.int64)
        n = len(text)
        at = np.arange(n)
        lead = text
        step = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        mark = np.frombuffer(MARK.encode(), np.uint8)
        r = at if n != len(mark) or word != MARK.encode() else at[:0]
        state = np.zeros(len(r), np.int64)
        single = np.zeros(n, bool)
        starts, ends, pieces = [], [], []
        for d in range(trie.depth):
            ok = r + d < n
            r, state = r[ok], state[ok]
            to = trie.base[state] + text[r + d] + 1
            ok = trie.check[to] == state
            r, state = r[ok], to[ok].astype(np.int64)
            if not len(r):
                break
            v = trie.value[state]
            has = v >= 0
            starts.append(r[has])
            ends.append(r[has] + d + 1)
            pieces.append(v[has])
            single[r[has][step[r[has]] == d + 1]] = True
        lost = np.flatnonzero(~single & ((text & 0xC0) != 0x80))
        starts.append(lost)
        ends.append(np.minimum(lost + step[lost], n))
        pieces.append(np.full(len(lost), -1))
        s, e, v = (np.concatenate(x) for x in (starts, ends, pieces))
        order = np.argsort(s, kind="stable")
        return s[order], e[order], v[order]

    def _alone(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, piece) of the best segmentation of one long word, edge by edge."""
        s, e, v = self._edges_of(word)
        score = np.where(v >= 0, self.v.scores[v], self.unknown).tolist()
        best = [-np.inf] * (len(word) + 1)
        best[0] = 0.0
        by = [-1] * (len(word) + 1)
        for k, (i, j, x) in enumerate(zip(s.tolist(), e.tolist(), score, strict=True)):
            if (y := best[i] + x) > best[j]:
                best[j], by[j] = y, k
        at, ids, j = [], [], len(word)
        while j:
            i, piece = int(s[by[j]]), int(v[by[j]])
            if piece >= 0:
                at.append(i)
                ids.append(piece)
            else:
                for b in range(j - 1, i - 1, -1):
                    at.append(b)
                    ids.append(int(self.v.byte_ids[word[b]]))
            j = i
        return np.array(at[::-1], np.int64), np.array(ids[::-1], np.int64)

    def _expected_alone(self, word: bytes, count: int, out: np.ndarray) -> int:
        """As ``_expected``, for one long word: sums of probabilities, rescaled as they go."""
        s, e, v = self._edges_of(word)
        score = np.where(v >= 0, self.v.scores[v], self.unknown)
        ahead, behind = ([-np.inf] * (len(word) + 1) for _ in range(2))
        ahead[0] = behind[len(word)] = 0.0
        edges = list(zip(s.tolist(), e.tolist(), score.tolist(), strict=True))
        for i, j, x in edges:
            a, b = ahead[j], ahead[i] + x
            if b > a:
                a, b = b, a
            ahead[j] = a + math.log1p(math.exp(b - a)) if b > -np.inf else a
        for i, j, x in reversed(edges):
            a, b = behind[i], behind[j] + x
            if b > a:
                a, b = b, a
            behind[i] = a + math.log1p(math.exp(b - a)) if b > -np.inf else a
        whole = ahead[-1]
        n = np.rint(np.exp(np.minimum(0, np.array(ahead)[s] + score + np.array(behind)[e] - whole)) * count / QUANTUM)
        np.add.at(out, v[v >= 0], n[v >= 0].astype(np.int64))
        return int(np.rint(whole * count * 1024))

    def _padded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words])
        text = np.zeros((len(words), int(size.max()) + 1), np.int64)
        text[np.arange(text.shape[1])[None, :] < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        return text, size

    def _edges(self, text: np.ndarray, size: np.ndarray, best: np.ndarray, never: float = -np.inf) -> Iterator[tuple[int, np.ndarray, int | np.ndarray, np.ndarray | None]]:
        """(first byte, words, end, pieces) of all pieces, by first byte; ends and None for characters without a piece.

        Only words whose ``best`` at the first byte is more than ``never`` by then are asked;
        each word stands once in one step.
        """
        trie = self.v.trie
        n, width = len(text), text.shape[1] - 1
        literal = text[:, 0] * 65536 + text[:, min(1, width)] * 256 + text[:, min(2, width)] == int.from_bytes(MARK.encode(), "big")
        for i in range(width):
            row = np.flatnonzero((size > i) & (best[:, i] > never))
            if not len(row):
                continue
            lead = text[row, i]
            step = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            single = np.zeros(n, bool)
            r, state = row[~literal[row]], np.zeros((~literal[row]).sum(), np.int64)
            length = np.zeros(n, np.int64)
            length[row] = step
            for d in range(i, min(width, i + trie.depth)):
                at = trie.base[state] + text[r, d] + 1
                ok = (size[r] > d) & (trie.check[at] == state)
                r, state = r[ok], at[ok].astype(np.int64)
                if not len(r):
                    break
                v = trie.value[state]
                has = v >= 0
                rr = r[has]
                single[rr[length[rr] == d + 1 - i]] = True
                if len(rr):
                    yield i, rr, d + 1, v[has]
            lost = ~single[row]
            if lost.any():
                yield i, row[lost], np.minimum(i + step[lost], size[row[lost]]), None

    def expected(self, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, int]:
        """Expected counts of all pieces over all segmentations of words that occur ``counts`` times, and their log likelihood.

        Both are sums of whole quanta.
        """
        out, likely = np.zeros(len(self.v.pieces), np.int64), 0
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        for o in order[size[order] >= LONG]:
            likely += self._expected_alone(words[o], int(counts[o]), out)
        order = order[size[order] < LONG]
        i = 0
        while i < len(order):
            j = min(len(order), i + 1 + (1 << 17) // (len(words[order[i]]) + 16))
            while j > i + 1 and len(words[order[j - 1]]) > 2 * len(words[order[i]]) + 8:
                j = i + (j - i) // 2
            likely += self._expected([words[o] for o in order[i:j]], counts[order[i:j]], out, int(size[order[j - 1]]) <= SHORT)
            i = j
        return out, likely

    def _expected(self, words: list[bytes], counts: np.ndarray, out: np.ndarray, short: bool) -> int:
        """Sums of products of probabilities over all segmentations of ``short`` words, else of their logarithms.

        Every segmentation covers all bytes, so that a factor for each byte changes no
        share; it keeps the products of most short words within what a double holds.
        Improbable ones, as of many characters without a piece, are done again by logarithms.
        """
        (text, size), scores = self._padded(words), self.v.scores
        whole_log = np.zeros(len(words))
        at = np.arange(len(words))
        ahead, behind = (np.full(text.shape, 0.0 if short else -np.inf) for _ in range(2))
        ahead[:, 0] = behind[at, size] = 1.0 if short else 0.0
        steps, pieces, parts = [], [], []
        for i, r, e, v in self._edges(text, size, ahead, 0.0 if short else -np.inf):
            s = scores[v] if v is not None else np.full(len(r), self.unknown)
            if short:
                s = np.exp(s + LIFT * (e - i))
                ahead[r, e] += ahead[r, i] * s
            else:
                ahead[r, e] = np.logaddexp(ahead[r, e], ahead[r, i] + s)
            steps.append((i, r, e, v, s))
        whole = ahead[at, size]
        again = 0
        if short and len(weak := np.flatnonzero(whole < LEAST_SUM)):
            again = self._expected([words[o] for o in weak], counts[weak], out, False)
            whole[weak], counts = 1.0, counts.copy()
            counts[weak] = 0
        whole_log = np.log(whole) - LIFT * size if short else whole
        per = counts / QUANTUM / whole if short else counts / QUANTUM
        for i, r, e, v, s in reversed(steps):
            if short:
                rest = behind[r, e] * s
                behind[r, i] += rest
                n = None if v is None else ahead[r, i] * rest * per[r]
            else:
                rest = behind[r, e] + s
                behind[r, i] = np.logaddexp(behind[r, i], rest)
                n = None if v is None else np.exp(ahead[r, i] + rest - whole[r]) * per[r]
            if n is not None:
                pieces.append(v)
                parts.append(np.rint(n))
        if pieces:  # whole numbers below 2**53: sums of doubles are exact
            v, n = np.concatenate(pieces), np.concatenate(parts)
            high = np.floor(n * 2.0**-26)
            out += np.bincount(v, high, len(out)).astype(np.int64) * (1 << 26) + np.bincount(v, n - high * 2.0**26, len(out)).astype(np.int64)
        return again + sum(int(x) for x in np.rint(whole_log * counts * 1024))

    def _batch(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, first byte, piece) for each piece of each word; byte pieces stand at their own bytes."""
        scores = self.v.scores
        n, (text, size) = len(words), self._padded(words)
        width = int(size.max())
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, width + 1), np.int64), np.full((n, width + 1), -1)
        for i, r, e, v in self._edges(text, size, best):
            score = best[r, i] + (scores[v] if v is not None else self.unknown)
            win = score > best[r, e]
            r, e = r[win], e if v is not None else e[win]
            best[r, e], start[r, e], piece[r, e] = score[win], i, -1 if v is None else v[win]
        rows, starts, pieces = [], [], []
        row, end = np.arange(n), size.copy()
        while len(row):
            p, s = piece[row, end], start[row, end]
            rows.append(row[p >= 0])
            starts.append(s[p >= 0])
            pieces.append(p[p >= 0])
            for k in range(4):
                at = s + k
                byte = (p < 0) & (at < end)
                rows.append(row[byte])
                starts.append(at[byte])
                pieces.append(self.v.byte_ids[text[row[byte], at[byte]]])
            row, end = row[s > 0], s[s > 0]
        return np.concatenate(rows), np.concatenate(starts), np.concatenate(pieces)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts of encoded rows, as UTF-8."""
        size = (self.piece_at[1:] - self.piece_at[:-1])[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = self.piece_bytes[np.arange(ends[-1]) + np.repeat(self.piece_at[ids] - ends[:-1], size)].tobytes()
        out = []
        for lo, hi in zip(ends[offsets[:-1]], ends[offsets[1:]], strict=True):
            t = flat[lo:hi]
            out.append(t[1:] if t[:1] == b" " else t)
        return out


def word_counts(docs: DataFrame, known: Broadcast) -> DataFrame:
    """(word, n): the distinct words of all texts, as they are segmented, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Encoder(known.value).split
        held: Counter[str] = Counter()
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    before = len(held)
                    held.update(split(" " + t))
                    size += len(t) if len(held) > before else 0
                if len(held) > MOST_WORDS or size > 1 << 26:
                    yield flush()
                    held.clear()
                    size = 0
        yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def estimated(docs: DataFrame, v: Vocabulary, most_rounds: int = MOST_ROUNDS) -> Vocabulary:
    """``v`` with unigram log probabilities of its pieces over all texts of ``docs``.

    From equal probabilities, each round takes the expected count of every piece
    over all segmentations of all words, and its share of their sum as the next
    probability. Rounds end when the log likelihood gains less than LEAST_GAIN of
    itself. A piece that is never expected gets the share of one quantum.
    """
    spark = docs.sparkSession
    plain = v.trie.value[v.trie.value >= 0]
    scores = np.full(len(v.pieces), -np.log(max(1, len(plain))))
    v, last = replace(v, scores=scores), None
    words = saved(word_counts(docs, spark.sparkContext.broadcast(v)), "words")
    for _ in range(most_rounds):
        known = spark.sparkContext.broadcast(v)

        def run(batches: Iterator[pa.RecordBatch], known: Broadcast = known) -> Iterator[pa.RecordBatch]:
            coder = Encoder(known.value)
            total, likely = np.zeros(len(coder.v.pieces), np.int64), 0
            some, counts, size = [], [], 0

            def take() -> None:
                nonlocal total, likely, size
                got, more = coder.expected(some, np.array(counts, np.int64))
                total, likely, size = total + got, likely + more, 0
                some.clear()
                counts.clear()

            for b in batches:
                for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    some.append(w.encode())
                    counts.append(n)
                    size += len(w)
                if size > 1 << 20:
                    take()
            take()
            (at,) = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], likely), pa.int64())], names=["piece", "n"])

        # At most one row for each piece comes to the driver.
        got = words.mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        likely = int(got.loc[got["piece"] < 0, "n"].sum())
        got = got[got["piece"] >= 0]
        if not len(got):
            break
        n = np.ones(len(v.pieces), np.int64)
        n[got["piece"]] = np.maximum(1, got["n"])
        v = replace(v, scores=np.log(n / int(n[plain].sum())))
        if last is not None and likely - last < LEAST_GAIN * abs(last):
            break
        last = likely
    return v


def encode(docs: DataFrame, path: str = MODEL, most: int = 1 << 20) -> DataFrame:
    """Encode whole texts: doc_id, ids (array of int), n_tokens, n_byte_tokens, ids_sha256 and round_trip.

    ids_sha256 is that of the ids as little-endian 32-bit integers; round_trip
    says that decoding gives the text back. A null or empty text has no pieces;
    a marker character in a text is encoded by its bytes, so that it isn't
    confused with a space; repeated rows are encoded each; other columns are
    ignored. ``path`` is the vocabulary file, read by the driver; the scores of its
    pieces are estimated over the texts of ``docs``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(estimated(docs, Vocabulary.load(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(known.value)
        is_byte = np.zeros(len(coder.v.pieces), bool)
        is_byte[coder.v.byte_ids] = True
        for b in batches:
            texts = b.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < most):
                    size += len(texts[j] or "")
                    j += 1
                ids, at = coder.encode(texts[i:j])
                back = coder.decode(ids, at)
                n_byte = np.concatenate(([0], np.cumsum(is_byte[ids])))[at]
                raw = ids.astype("<i4").tobytes()
                sha = [hashlib.sha256(raw[4 * lo : 4 * hi]).hexdigest() for lo, hi in zip(at[:-1], at[1:], strict=True)]
                same = [x == (t or "").encode() for x, t in zip(back, texts[i:j], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(at)), pa.array(np.diff(n_byte), pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"])
                i = j

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """Decode ``ids``: doc_id and text. Null or empty ids give an empty text; special pieces give none."""
    known = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(known.value)
        for b in batches:
            rows = [np.array(x or [], np.int64) for x in b.column(1).to_pylist()]
            at = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)
            text = [x.decode(errors="replace") for x in coder.decode(np.concatenate([np.zeros(0, np.int64), *rows]), at)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document: their number, digest and round trip."""
    return encode(table(spark, sf_dir, "documents")).drop("ids")
