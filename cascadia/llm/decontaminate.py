"""Benchmark decontamination with suffix arrays of the training documents.

Each task turns the documents it reads into shards of about a megabyte. A
shard's suffix array holds all its word positions in lexicographic order of the
word sequences that follow. Every benchmark suffix whose words the shard knows is
binary-searched in it; what is found is extended to the longest verbatim match
and reported with its location.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import filtered, saved, small_batches, table

U64 = np.uint64
#: Bytes of benchmark text that one broadcast holds; a larger benchmark is searched block by block.
BLOCK = 8 << 20
#: Places of windows in a shard and the items that are held at once.
EXPAND = 1 << 20


class Suffixes:
    """Benchmark suffixes: the words of all items and the windows to search for."""

    def __init__(self, items: list[str], texts: list[str], window: int):
        hashes, bounds = [], [0]
        for text in texts:
            h = np.zeros(0, U64)
            for _, _, buf, off in K.text_chunks(pa.array([text])):
                h, _ = K.word_hashes(buf, off, K.ALNUM)
            hashes.append(h)
            bounds.append(bounds[-1] + len(h))
        self.items = items
        self.words = np.concatenate([*hashes, np.zeros(window, U64)])
        self.bounds = np.array(bounds)
        start, size, item = [], [], []
        for i, h in enumerate(hashes):
            if len(h):
                n = min(window, len(h))
                s = np.arange(bounds[i], bounds[i + 1] - n + 1)
                start.append(s)
                size.append(np.full(len(s), n))
                item.append(np.full(len(s), i))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.start, self.size, self.item = cat(start), cat(size), cat(item)
        # Equal windows are searched once.
        self.keys = np.stack([np.where(self.size > j, self.words[self.start + j], 0) for j in range(window)], 1) if len(self.start) else np.zeros((0, window), U64)
        self.unique, self.which = np.unique(self.keys, axis=0, return_inverse=True) if len(self.keys) else (self.keys, np.zeros(0, np.int64))
        self.which = self.which.ravel()
        self.unique_size = (self.unique != 0).sum(1)
        self.by_key = np.argsort(self.which, kind="stable")
        self.key_at = np.searchsorted(self.which[self.by_key], np.arange(len(self.unique) + 1))
        self.vocabulary, code = np.unique(self.unique, return_inverse=True)  # 0 fills up short items
        self.codes = code.reshape(self.unique.shape)


def suffix_array(codes: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Word positions in the order of the ``width`` words or more that follow in their document; ties by position."""
    n = len(codes)
    rank, size = codes.astype(np.int64) + 1, 1
    at = np.arange(n)
    while True:
        next_ = np.where(at + size < end, rank[np.minimum(at + size, n - 1)], 0)
        key = rank * (n + 2) + next_
        size *= 2
        order = np.argsort(key, kind="stable")
        if size >= width:
            return order
        s = key[order]
        rank[order] = np.cumsum(np.concatenate(([1], s[1:] != s[:-1])))


def search(words: np.ndarray, row: np.ndarray, s: Suffixes) -> tuple[np.ndarray, ...]:
    """(row, first word in the shard, item, first word in the item, words) of each longest match in a shard."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n, width = len(words), s.unique.shape[1]
    if not n or not len(s.unique):
        return none
    known, codes = np.unique(words, return_inverse=True)
    at = np.minimum(np.searchsorted(known, s.vocabulary), len(known) - 1)
    here = (known[at] == s.vocabulary) | (s.vocabulary == 0)
    maybe = np.flatnonzero(here[s.codes].all(1))
    if not len(maybe):
        return none
    end = np.searchsorted(row, row, "right")
    pos = suffix_array(codes, end, width)
    padded = np.concatenate((words, np.zeros(width, U64)))
    asked, sizes, ahead = s.unique[maybe], s.unique_size[maybe], np.arange(width)

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(maybe), np.int64), np.full(len(maybe), n)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            p = pos[np.minimum(mid, n - 1)][:, None] + ahead
            at = np.where(p < end[p[:, 0]][:, None], padded[p], 0)
            differs = (at != asked) & (ahead < sizes[:, None])
            j = np.argmax(differs, 1)
            some, rows = differs.any(1), np.arange(len(mid))
            less = np.where(some, at[rows, j] < asked[rows, j], upper)
            open_ = lo < hi
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    lo, hi = bound(False), bound(True)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return none
    # Each place of a window in the shard, with each place of it in the items, some at a time.
    lo, places, found = lo[found], (hi - lo)[found], maybe[found]
    homes = s.key_at[found + 1] - s.key_at[found]
    ends = np.cumsum(places * homes)
    kept = []
    for first in range(0, ends[-1], EXPAND):
        flat = np.arange(first, min(first + EXPAND, ends[-1]))
        which = np.searchsorted(ends, flat, "right")
        h = homes[which]
        k = flat - ends[which] + places[which] * h
        p = pos[lo[which] + k // h]
        w = s.by_key[s.key_at[found[which]] + k % h]
        q, item = s.start[w], s.item[w]
        inside = (p > 0) & (q > s.bounds[item])
        left = inside & (row[np.maximum(p - 1, 0)] == row[p]) & (words[np.maximum(p - 1, 0)] == s.words[np.maximum(q - 1, 0)])
        # A match that goes on to the left is part of a longer one, unless a shorter item's only window begins here.
        kept.append([x[~left] for x in (p, q, item, w)])
    p, q, item, w = (np.concatenate(x) for x in zip(*kept, strict=True))
    size = s.size[w].astype(np.int64)
    live = np.arange(len(p))
    while len(live):
        a, b = p[live] + size[live], q[live] + size[live]
        ok = (a < end[p[live]]) & (b < s.bounds[item[live] + 1])
        ok &= padded[np.minimum(a, n)] == s.words[np.minimum(b, len(s.words) - 1)]
        live = live[ok]
        size[live] += 1
    return row[p], p, item, q - s.bounds[item], size


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK))
    return [b] if n == 1 else [b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


MATCHES = "matches array<struct<item_id: string, doc_word: long, item_word: long, n_words: long>>"


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words and matches, the longest verbatim
    matches as (item_id, doc_word, item_word, n_words).

    Rows are never told apart by doc_id: with several benchmark blocks, each adds
    its matches to the row as the last one left it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.select("doc_id", "text", F.lit(None).cast("long").alias("n_words"), F.expr("array()").cast(MATCHES.split(" ", 1)[1]).alias("matches"))
    blocks = _blocks(benchmark)
    for k, block in enumerate(blocks):
        rows = block.collect()  # at most BLOCK bytes of text
        known = spark.sparkContext.broadcast(Suffixes([r[0] for r in rows], [r[1] for r in rows], window))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            s = known.value
            names = np.array([*s.items, None], dtype=object)
            for b in batches:
                counts, offsets, cols = [], [0], [[], [], [], []]
                for i, j, buf, off in K.text_chunks(b.column(1)):
                    words, row = K.word_hashes(buf, off, K.ALNUM)
                    first = np.searchsorted(row, np.arange(j - i + 1))
                    counts.append(np.diff(first))
                    r, p, item, q, size = search(words, row, s)
                    order = np.argsort(r, kind="stable")
                    r, p, item, q, size = (x[order] for x in (r, p, item, q, size))
                    offsets.extend(offsets[-1] + np.searchsorted(r, np.arange(1, j - i + 1)))
                    for c, x in zip(cols, (names[item], p - first[r], q, size), strict=True):
                        c.append(x)
                item_ids, *rest = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
                fields = pa.StructArray.from_arrays([pa.array(list(item_ids), pa.string()), *(pa.array(x, pa.int64()) for x in rest)], ["item_id", "doc_word", "item_word", "n_words"])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(counts) if counts else [], pa.int64()), b.column(3), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)], names=["doc_id", "text", "n_words", "matches", "more"])

        part = out.mapInArrow(run, f"doc_id long, text string, n_words long, {MATCHES}, more {MATCHES.split(' ', 1)[1]}")
        out = part.select("doc_id", "text", "n_words", F.concat("matches", "more").alias("matches"))
        if k < len(blocks) - 1:
            out = saved(out, "matches")
    return out.drop("text")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """How much of each document stands in benchmark items.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
    lower-cased. A window is ``window`` words of an item in a row, or a whole
    shorter item; words that any occurrence of a window covers are hit. Returns
    one row per document: doc_id, n_words, n_hit, n_items (items with occurring
    windows), items_sha256 (of their ids, sorted as strings and comma-joined),
    contaminated (n_hit > 0) and matches (the longest verbatim matches).

    Rows are judged each by its own text, also with null or repeated doc_ids. Null texts have no words; a null item_id never counts
    as an item; an empty benchmark hits nothing; repeated items count by their
    ids; other columns are ignored.
    """
    found = benchmark_matches(docs, benchmark, window)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            hits, n_items, sha = [], [], []
            for found in d["matches"]:
                hit, at = 0, -1
                for m in sorted(found, key=lambda m: m["doc_word"]):
                    lo, hi = max(at, m["doc_word"]), m["doc_word"] + m["n_words"]
                    hit += max(0, hi - lo)
                    at = max(at, hi)
                ids = sorted({m["item_id"] for m in found} - {None})
                hits.append(hit)
                n_items.append(len(ids))
                sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": d["doc_id"], "n_words": d["n_words"], "n_hit": pd.Series(hits, dtype="int64"), "n_items": pd.Series(n_items, dtype="int64"), "items_sha256": pd.Series(sha, dtype="object"), "contaminated": pd.Series([h > 0 for h in hits], dtype="bool"), "matches": d["matches"]})

    return found.mapInPandas(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, matches array<struct<item_id: string, doc_word: long, item_word: long, n_words: long>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, all their columns, that hold no benchmark window."""
    small_batches(docs.sparkSession)
    for block in _blocks(benchmark):
        rows = block.collect()  # at most BLOCK bytes of text
        known = docs.sparkSession.sparkContext.broadcast(Suffixes([r[0] for r in rows], [r[1] for r in rows], window))

        def clean(texts: pa.Array, known=known) -> np.ndarray:
            ok = np.ones(len(texts), bool)
            for i, _, buf, off in K.text_chunks(texts):
                words, row = K.word_hashes(buf, off, K.ALNUM)
                ok[i + search(words, row, known.value)[0]] = False
            return ok

        docs = filtered(docs, lambda clean=clean: clean)
    return docs


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("matches")
