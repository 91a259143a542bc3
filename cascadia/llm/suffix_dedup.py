"""Removal of long repeated byte strings by a run-length suffix index.

Every string of ``length`` bytes is dealt by its minimizer, the least hash of
the k-byte strings within it, so that all its occurrences meet. Strings in a row
that have one minimizer make a segment. Segments whose minimizer occurs at one place only
are left where they are; of the others, one copy of each distinct content goes to
an index shard.

A minimizer with many distinct contents (one at the ends of a common passage, where
each document has neighbouring bytes of its own) is dealt once more, string by
string: by the place of the minimizer within the string, in blocks, and by the bytes
that all strings of a block have in common; if need be again, by the whole string.

A shard concatenates its contents in order of occurrence, sorts the suffixes,
and keeps the Burrows-Wheeler transform as runs with the suffix positions at the
run ends. Between two sampled positions the lexicographic neighbour of a suffix
moves along with it, so the sampled run heads give, for every text position as
it streams by, its neighbour and the length of their match (matching
statistics). Runs of neighbours that match over ``length`` bytes are the
occurrences of one string; all but the earliest are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import placed, saved, small_batches, table, unused

U64 = np.uint64
GRAM = 20
#: Starts of one segment at most; longer runs are cut.
MOST_STARTS = 256
#: Segments that a task gathers before it sends them.
FLUSH = 1 << 18
#: Bytes that one kernel call cuts into segments.
SLICE = 1 << 20
#: Bytes of one index shard, about.
SHARD = 1 << 20
#: Bytes of distinct contents beyond which a minimizer is dealt once more.
HOT = SHARD
#: Places of the minimizer in one block when it is dealt once more, and once again.
STEPS = (9, 1)
#: Segments of one minimizer in a lot beyond which they are dealt by their content.
MANY = 16
#: Flags beside the number of starts.
INNER, KNOWN, COPY, WITNESS = 1 << 15, 1 << 14, 1 << 13, 1 << 12


def segments(buf: np.ndarray, off: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(minimizer, content hash, row, start, number of starts, inner) of each segment.

    A segment covers starts + length - 1 bytes. ``inner``: the minimizer stands
    at several places in it, so that it may repeat a string of its own.
    """
    parts = []
    for at in range(0, max(1, len(buf) - length + 1), SLICE - length + 1):
        parts.append(_segments(buf, off, at, min(len(buf), at + SLICE), length, gram))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _minimizers(c: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimizer, its place) of each string of ``length`` bytes of at most SLICE bytes, from their ``prefix_hash``."""
    _, down = K.powers(len(c))
    n = len(c) - gram
    h = K.mix((c[gram:] - c[:-gram]) * down[:n])
    # The least hash with the leftmost place of it: a function of the string alone.
    m = (h & ~U64(SLICE - 1)) | np.arange(n, dtype=U64)
    width, s = length - gram + 1, 1
    while 2 * s <= width:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    if width > s:
        m = np.minimum(m[: s - width], m[width - s :])
    place = (m & U64(SLICE - 1)).astype(np.int64)
    return h[place], place


def blocks(contents: list[bytes], step: int, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, content hash, index, start, number of starts) of runs of strings of the contents, at most SLICE bytes in all.

    A run has one minimizer at one place, which stands at ``step`` places within its
    strings; the key is of the minimizer, of those places and of the bytes that all
    strings share which have it there. Equal strings have equal keys.
    """
    buf = np.frombuffer(b"".join(contents), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(x) for x in contents])))
    c = K.prefix_hash(buf)
    v, place = _minimizers(c, length, gram)
    at = np.arange(len(v))
    row = np.searchsorted(off, at, "right") - 1
    ok = at + length <= off[row + 1]
    v, place, at, row = v[ok], place[ok], at[ok], row[ok]
    q = (place - at) // step
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (q[1:] != q[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    v, place, at, row, q = (x[first] for x in (v, place, at, row, q))
    core = K.span_hash(c, place - q * step, place - q * step - step + 1 + length)
    key = K.mix(v ^ K.mix(core + q.astype(U64)))
    return key, K.span_hash(c, at, at + count + length - 1), row, at - off[row], count


def _segments(whole: np.ndarray, off: np.ndarray, lo: int, hi: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    none = tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64, np.int64, bool))
    buf = whole[lo:hi]
    if len(buf) < length:
        return none
    c = K.prefix_hash(buf)
    m, place = _minimizers(c, length, gram)
    row = np.searchsorted(off, lo + np.arange(len(m)), "right") - 1
    ok = lo + np.arange(len(m)) + length <= off[row + 1]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(m)))
    count, first = count[ok[first]], first[ok[first]]
    if not len(first):
        return none
    pieces = -(-count // MOST_STARTS)
    of = np.repeat(np.arange(len(first)), pieces)
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first[of] + k * MOST_STARTS
    count = np.minimum(MOST_STARTS, count[of] - k * MOST_STARTS)
    inner = place[start] != place[start + count - 1]
    return m[start], K.span_hash(c, start, start + count + length - 1), row[start], lo + start - off[row[start]], count, inner


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffix array of pieces laid end to end; ``left`` is the number of bytes to the piece's end.

    A suffix ends with its piece; equal ones stand in order of position.
    """
    n = len(text)
    wide = np.concatenate((text.astype(np.int64) + 1, np.zeros(8, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key * 512 + np.where(left > j, wide[j : n + j], 0)
    sa = np.argsort(key, kind="stable")
    s = key[sa]
    head = np.ones(n, bool)
    head[1:] = s[1:] != s[:-1]
    rank = np.empty(n, np.int64)
    at = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[sa] = at + 1
    h = 7
    open_ = np.flatnonzero(~head | ~np.append(head[1:], True))
    while len(open_):
        i = sa[open_]
        more = left[i] > h
        if not more.any():
            break
        second = np.where(more, rank[np.minimum(i + h, n - 1)], 0)
        key = (rank[i] << 32) | second
        order = np.argsort(key, kind="stable")
        i, key = i[order], key[order]
        sa[open_] = i
        first = np.ones(len(i), bool)
        first[1:] = key[1:] != key[:-1]
        rank[i] = open_[np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))] + 1
        open_ = open_[~first | ~np.append(first[1:], True)]
        h *= 2
    return sa


class RunIndex:
    """A Burrows-Wheeler transform in runs, with the suffix positions at the run ends."""

    def __init__(self, text: np.ndarray, left: np.ndarray):
        sa = suffix_array(text, left)
        before = np.where(sa > 0, text[sa - 1].astype(np.int16), -1)
        # The first byte of a piece has no byte before it: such rows are runs of their own.
        begins = np.ones(len(text), bool)
        begins[1:] = left[:-1] == 1
        before = np.where(begins[sa], -1, before)
        head = np.ones(len(sa), bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        heads = np.flatnonzero(head)
        self.symbols = before[heads]
        self.lengths = np.diff(np.append(heads, len(sa)))
        self.head_at = sa[heads]
        self.tail_at = sa[heads + self.lengths - 1]
        self.text, self.left = text, left

    def matching_statistics(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text position, its preceding neighbour in suffix order (-1: none) and the length of their match.

        Matches are measured up to ``most`` bytes past each run head's own need.
        """
        p = self.head_at
        q = np.concatenate(([-1], self.tail_at[:-1]))
        match = self._extend(p, q)
        order = np.argsort(p)
        p, q, match = p[order], q[order], match[order]
        i = np.arange(len(self.text))
        s = np.searchsorted(p, i, "right") - 1
        gap = i - p[s]
        near = np.where(q[s] >= 0, q[s] + gap, -1)
        return near, np.maximum(0, match[s] - gap)

    def _extend(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        t = np.concatenate((self.text, np.zeros(8, np.uint8)))
        eight = np.lib.stride_tricks.sliding_window_view(t, 8)
        n = np.zeros(len(p), np.int64)
        live = np.flatnonzero(q >= 0)
        most = np.minimum(self.left[p], self.left[np.maximum(q, 0)])
        while len(live):
            a, b = p[live] + n[live], q[live] + n[live]
            same = eight[a] == eight[b]
            k = np.where(same.all(1), 8, np.argmin(same, 1))
            n[live] += k
            live = live[(k == 8) & (n[live] < most[live])]
        return np.where(q >= 0, np.minimum(n, most), 0)


def repeated(contents: list[bytes], starts: np.ndarray, length: int) -> list[np.ndarray]:
    """For contents in order of occurrence, which of their starts open a string of ``length`` bytes seen earlier."""
    text = np.frombuffer(b"".join(contents), np.uint8)
    size = np.array([len(c) for c in contents])
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(text))
    index = RunIndex(text, left)
    near, match = index.matching_statistics(length)
    # Follow neighbours while they match over the whole length, to one head per string.
    n = len(text)
    hop = np.where((match >= length) & (left >= length), near, np.arange(n))
    while True:
        further = hop[hop]
        if (further == hop).all():
            break
        hop = further
    earliest = np.full(n, n)
    np.minimum.at(earliest, hop, np.arange(n))
    seen = earliest[hop] < np.arange(n)
    return [seen[e - s : e - s + k] for e, s, k in zip(end, size, starts, strict=True)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def segment_blobs(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """Segments by range of their minimizers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            v, c, doc, start, count, inner = (np.concatenate(x) for x in zip(*held, strict=True))
            count = count.astype(np.uint16) | np.where(inner, INNER, 0).astype(np.uint16)
            by = K.mix(v)  # minimizers are small numbers
            # Those with many segments are known to repeat: contents are dealt on their own, their copies anywhere.
            values, of, n_of = np.unique(v, return_inverse=True, return_counts=True)
            many = np.flatnonzero(n_of[of] > MANY)
            if len(many):
                own = many[np.lexsort((start[many], doc[many], c[many], v[many]))]
                again = own[1:][(v[own[1:]] == v[own[:-1]]) & (c[own[1:]] == c[own[:-1]])]
                count[many] |= KNOWN
                count[again] |= COPY
                by[many] = K.mix(v[many] ^ K.mix(c[many]))
                by[again] = K.mix(by[again] + doc[again].view(U64) * U64(31) + start[again].astype(U64))
                # A witness of each minimizer tells those of other lots.
                seen = values[n_of > MANY]
                none = np.zeros(len(seen), np.int64)
                v, c, doc, start = (np.concatenate(x) for x in ((v, seen), (c, none.astype(U64)), (doc, none + doc[0]), (start, none)))
                count, by = np.concatenate((count, np.full(len(seen), WITNESS, np.uint16))), np.concatenate((by, K.mix(seen)))
            r = (by >> U64(64 - bits)).astype(np.int64)
            order = np.argsort(r, kind="stable")
            ids, at = np.unique(r[order], return_index=True)
            at = np.append(at, len(r))
            cols: list[list] = [[] for _ in range(6)]
            for i in range(len(ids)):
                o = order[at[i] : at[i + 1]]
                own, idx = np.unique(doc[o], return_inverse=True)
                for col, x in zip(cols, (v[o], c[o], own, idx.astype(np.uint32 if len(own) > 65535 else np.uint16), start[o].astype(np.uint32), count[o]), strict=True):
                    col.append(x.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(x, pa.binary()) for x in cols)], names=["r", "v", "c", "ids", "doc", "start", "count"])

        for b in batches:
            ids = np.asarray(b.column(0))
            for i, _, buf, off in K.text_chunks(b.column(1), SLICE // 4):
                v, c, row, start, count, inner = segments(buf, off, length)
                if len(v):
                    held.append((v, c, ids[i + row], start, count, inner))
                    n += len(v)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "r long, v binary, c binary, ids binary, doc binary, start binary, count binary")


def shared_segments(blobs: DataFrame) -> DataFrame:
    """Segments whose minimizer occurs at more than one place; ``first`` marks the earliest of equal content that met."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        parts = []
        for x in t.to_pylist():
            ids = np.frombuffer(x["ids"], np.int64)
            doc = np.frombuffer(x["doc"], np.uint16 if len(ids) <= 65535 else np.uint32)
            parts.append((np.frombuffer(x["v"], U64), np.frombuffer(x["c"], U64), ids[doc], np.frombuffer(x["start"], np.uint32).astype(np.int64), np.frombuffer(x["count"], np.uint16).astype(np.int64)))
        rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
        copy = rows[4] & COPY > 0
        copies = [x[copy] for x in rows]
        v, c, doc, start, count = (x[~copy] for x in rows)
        order = np.argsort(v)
        s = v[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        some = same | (count[order] & (INNER | KNOWN) > 0)
        some[:-1] |= same[1:]
        order = order[some & (count[order] & WITNESS == 0)]
        order = order[np.lexsort((start[order], doc[order], c[order], v[order]))]
        v, c, doc, start, count = (x[order] for x in (v, c, doc, start, count))
        first = np.ones(len(v), bool)
        first[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
        v, c, doc, start, count = (np.concatenate(x) for x in zip((v, c, doc, start, count), copies, strict=True))
        first, count = np.append(first, np.zeros(len(copies[0]), bool)), count & (WITNESS - 1)
        return pa.table({"doc_id": doc, "v": v.view(np.int64), "start": start, "count": count, "first": first})

    return blobs.groupBy("r").applyInArrow(run, "doc_id long, v long, start long, count long, first boolean")


def contents(docs: DataFrame, firsts: DataFrame, length: int, shards: int) -> DataFrame:
    """The bytes of the first segments, by index shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, v, start, count, data = [], [], [], [], []
            for i, text, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = text.encode()
                for s in segs:
                    doc.append(i)
                    v.append(s["v"])
                    start.append(s["start"])
                    count.append(s["count"])
                    data.append(raw[s["start"] : s["start"] + s["count"] + length - 1])
            shard = K.mix(np.array(v, np.int64).view(U64)) % U64(shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(doc, pa.int64()), pa.array(v, pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(data, pa.binary())], names=["shard", "doc_id", "v", "start", "count", "content"])

    segs = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("v", "start", "count")).alias("segs"))
    both = docs.select("doc_id", "text").join(segs, "doc_id").select("doc_id", "text", "segs")
    return both.mapInArrow(run, "shard long, doc_id long, v long, start long, count long, content binary")


def dealt_again(docs: DataFrame, firsts: DataFrame, length: int, step: int) -> DataFrame:
    """Segments cut into the runs of ``blocks``, with these as minimizers; ``first`` marks the earliest of equal content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lot, of, base, size = [], [], [], 0
            out = []

            def cut() -> None:
                key, c, row, start, count = blocks(lot, step, length)
                out.append((np.array(of)[row], key, c, np.array(base)[row] + start, count))

            for i, text, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = text.encode()
                for s in segs:
                    if size + s["count"] + length > SLICE:
                        cut()
                        lot, of, base, size = [], [], [], 0
                    lot.append(raw[s["start"] : s["start"] + s["count"] + length - 1])
                    of.append(i)
                    base.append(s["start"])
                    size += len(lot[-1])
            if lot:
                cut()
            if out:
                doc, key, c, start, count = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key.view(np.int64)), pa.array(c.view(np.int64)), pa.array(start, pa.int64()), pa.array(count, pa.int64())], names=["doc_id", "v", "c", "start", "count"])

    # Written, so that its size is known: texts are shuffled again only if it is too large to broadcast.
    segs = saved(firsts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count")).alias("segs")), "hot-segments")
    runs = saved(docs.select("doc_id", "text").join(segs, "doc_id").select("doc_id", "text", "segs").mapInArrow(run, "doc_id long, v long, c long, start long, count long"), "runs")
    least = runs.groupBy("v", "c").agg(F.min(F.struct("doc_id", "start")).alias("least"))
    return runs.join(least, ["v", "c"]).select("doc_id", "v", "start", "count", (F.struct("doc_id", "start") == F.col("least")).alias("first"))


def index_marks(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, lo, hi): runs of starts whose strings a shard's index has seen earlier."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        doc, start, count = (t.column(x).to_numpy() for x in ("doc_id", "start", "count"))
        order = np.lexsort((start, doc))
        data = t.column("content").to_pylist()
        out_doc, out_lo, out_hi = [], [], []
        for k, seen in zip(order, repeated([data[i] for i in order], count[order], length), strict=True):
            if seen.any():
                lo, hi = _runs(seen)
                out_doc += [doc[k]] * len(lo)
                out_lo.append(start[k] + lo)
                out_hi.append(start[k] + hi)
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"doc_id": pa.array(out_doc, pa.int64()), "lo": cat(out_lo), "hi": cat(out_hi)})

    return rows.groupBy("shard").applyInArrow(run, "doc_id long, lo long, hi long")


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, spans): for documents that repeat earlier strings, the starts of those strings as runs [lo, hi).

    A row without a doc_id has no place in the order: it repeats nothing, and nothing repeats it.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    small_batches(spark)
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(20, max(4, int(np.ceil(np.log2(max(1, n / (24 << 20)))))))
    refs = saved(shared_segments(segment_blobs(docs, length, bits)), "segments")
    parts = []
    for step in STEPS:
        hot = saved(refs.where("first").groupBy("v").agg(F.sum(F.col("count") + length - 1).alias("size")).where(F.col("size") > HOT).select("v"), "hot")
        if hot.isEmpty():
            break
        parts += [refs.where("not first"), refs.where("first").join(hot, "v", "left_anti").select(refs.columns)]
        refs = saved(dealt_again(docs, refs.where("first").join(hot, "v", "left_semi"), length, step), "segments")
    for p in parts:
        refs = refs.unionByName(p)
    firsts = refs.where("first")
    size = firsts.agg(F.sum(F.col("count") + length - 1)).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    marks = index_marks(contents(docs, firsts, length, shards), length)
    copies = refs.where("not first").select("doc_id", F.col("start").alias("lo"), (F.col("start") + F.col("count")).alias("hi"))
    return marks.union(copies).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def cut_spans(raw: bytes, starts: list | None, length: int) -> tuple[bytes, int, int]:
    """What is left of ``raw``, the number of bytes removed, and of maximal removed runs."""
    runs: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"] + length - 1) for x in starts or ()):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    edges = [0, *(x for r in runs for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), sum(b - a for a, b in runs), len(runs)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with what ``suffix_dedup`` keeps of each text, and n_chars, if it is there, set to its length.

    A character that is cut through goes. All rows stay, also those with nothing left;
    rows with a null doc_id stay as they are. Rows of one doc_id are taken in turn, so
    that one of equal rows keeps its text.
    """
    rows, place = placed(docs)
    spans = repeated_spans(rows.select(F.col(place).alias("doc_id"), "text"), length)
    names, kind = docs.columns, docs.schema
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.columns[:-1]
            new = [t if not s else cut_spans(t.encode(), s, length)[0].decode(errors="ignore") for t, s in zip(cols[text].to_pylist(), b.columns[-1].to_pylist(), strict=True)]
            cols[text] = pa.array(new, pa.string())
            if chars is not None:
                cols[chars] = pa.array([None if t is None else len(t) for t in new]).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    own = unused("spans", rows.columns)
    both = rows.join(spans.select(F.col("doc_id").alias(place), F.col("spans").alias(own)), place, "left").select(*names, own)
    return both.mapInArrow(run, kind)


def suffix_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts earlier.

    Earlier is a smaller doc_id, or the same document and an earlier start;
    overlapping occurrences count. Strings are judged on the input. Returns one
    row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept (binary, the remaining bytes) and kept_sha256 (lowercase hex).

    Rows that share a doc_id, repeated ones too, stand in an order of their own within it
    (that of the table's parts), so that one copy of what they repeat stays. Rows where doc_id is null have no place
    in the order, so they keep all bytes and others keep theirs beside them. A null text is empty;
    texts shorter than ``length`` keep all bytes; texts are taken whole; an empty table
    gives no rows; other columns are ignored.
    """
    rows, place = placed(docs.select("doc_id", "text"))
    spans = repeated_spans(rows.select(F.col(place).alias("doc_id"), "text"), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [(t or "").encode() for t in b.column(1).to_pylist()]
            cut = [cut_spans(raw, s, length) for raw, s in zip(raws, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raws), pa.int64()), pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.int64()), pa.array([c[0] for c in cut], pa.binary()), pa.array([hashlib.sha256(c[0]).hexdigest() for c in cut], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    # As ``contents`` reads the same rows by the same key, their shuffle is made once.
    found = spans.select(F.col("doc_id").alias(place), "spans")
    both = rows.where("doc_id is not null").join(found, place, "left").select("doc_id", "text", "spans")
    both = both.union(rows.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without bytes of earlier 100-byte strings."""
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")
