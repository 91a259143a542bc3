"""Runs of consecutive words with a period, by Lyndon roots.

Every run (a maximal repetition) has a Lyndon root under one of the two orders of
the words, the usual or the reversed one: a longest Lyndon word at some place whose
length is the period. The longest Lyndon words at all places, the Lyndon array, are what the
first phase of Baier's suffix sorter keeps: it groups suffixes by their Lyndon
prefixes and refines the groups from the greatest down, so that no suffixes need be
sorted. Each root is then extended to both sides by longest common extensions.

A run of twelve words or more is covered by six-word strings that occur at least
twice in its document, so only stretches of such strings are searched; this leaves
out no run, and most texts have few such stretches. All documents of a chunk are
grouped together, with a separator between the stretches that is less than any word
under both orders.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import small_batches, table

U64 = np.uint64
#: Words of a run at least; it also holds its period twice.
LEAST = 12
#: Words of a string that must occur twice: a run of LEAST words repeats half of its words at least.
GRAM = LEAST // 2
#: Two primes below 2**31 and bases, for exact arithmetic in 64 bits.
PRIMES = ((2147483647, 1103515245), (2147483629, 69069069))


def lyndon_array(x: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place of ``x``; zeros are separators and have 0.

    The groups of suffixes stand in ``order`` as ranges, the less the further left;
    a group's start is its name. From the greatest group down, each suffix of a group
    finds the last place before it whose group is less: the Lyndon prefix there is
    followed by the one here, so it grows by it, as often as it stands there in a row.
    """
    n = len(x)
    sort = np.argsort(x, kind="stable")
    s = x[sort]
    head = np.ones(n, bool)
    head[1:] = s[1:] != s[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    place = np.empty(n, np.int64)
    place[sort] = np.arange(n)
    group = np.empty(n, np.int64)
    group[sort] = first
    zeros = int(np.searchsorted(s, 1))  # separators are the least group and stay it
    size = np.bincount(first, minlength=n).tolist()
    order, place, group = sort.tolist(), place.tolist(), group.tolist()
    length = [1] * n
    before = list(range(-1, n - 1))
    at = n - 1
    while at >= zeros:
        start = group[order[at]]
        if start == at:  # a group of one suffix
            members = (order[at],)
        else:
            members = sorted(order[start : at + 1])
        grow = length[start]
        times: dict[int, int] = {}
        for i in members:
            p = before[i]
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0 and group[p] >= zeros:
                times[p] = times.get(p, 0) + 1
        if len(times) == 1:
            lots = [times.items()]
        else:
            by: dict[int, list] = {}
            for p, k in times.items():
                by.setdefault(k, []).append((p, k))
            lots = [by[k] for k in sorted(by, reverse=True)]
        for lot in lots:
            moved: dict[int, list[int]] = {}
            for p, k in lot:
                moved.setdefault(group[p], []).append(p)
            for g, ps in moved.items():
                if len(ps) == size[g]:
                    length[g] += k * grow
                    continue
                end = g + size[g]
                new = end - len(ps)
                for p in ps:
                    end -= 1
                    a, q = place[p], order[end]
                    order[a], order[end] = q, p
                    place[q], place[p] = a, end
                    group[p] = new
                size[g] -= len(ps)
                size[new] = len(ps)
                length[new] = length[g] + k * grow
        at = start - 1
    of = np.array(group)
    return np.where(x > 0, np.array(length)[of], 0)


class Extensions:
    """Longest common extensions of places in a row of numbers, by two modular hashes of prefixes."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.n, self.sums, self.powers = n, [], []
        for prime, base in PRIMES:
            power = np.ones(1, np.int64)
            while len(power) <= n:
                power = np.concatenate((power, power * (int(power[-1]) * base % prime) % prime))
            power = power[: n + 1]
            c = np.zeros(n + 1, np.int64)
            np.cumsum((x.astype(np.int64) + 1) % prime * power[:n] % prime, out=c[1:])
            self.sums.append(c % prime)
            self.powers.append(power)

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` numbers from i on are those from j on, where i < j."""
        ok = np.ones(len(i), bool)
        for (prime, _), c, power in zip(PRIMES, self.sums, self.powers, strict=True):
            a, b = c[i + size] - c[i], c[j + size] - c[j]
            ok &= (a % prime) * power[j - i] % prime == b % prime
        return ok

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i on equal those from j on, i < j."""
        return self._extend(i, j, self.n - j, lambda i, j, done, step: (i + done, j + done))

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers before i equal those before j, i < j."""
        return self._extend(i, j, i, lambda i, j, done, step: (i - done - step, j - done - step))

    def _extend(self, i, j, most, where) -> np.ndarray:
        """Steps double while they match and are then halved, for all pairs at once."""
        done, step = np.zeros(len(i), np.int64), np.ones(len(i), np.int64)
        live = np.arange(len(i))
        growing = np.ones(len(i), bool)
        while len(live):
            fits = done[live] + step[live] <= most[live]
            ok = np.zeros(len(live), bool)
            k = live[fits]
            ok[fits] = self.same(*where(i[k], j[k], done[k], step[k]), step[k])
            done[live[ok]] += step[live[ok]]
            growing[live[~ok]] = False
            up = growing[live]
            step[live[up]] *= 2
            step[live[~up]] //= 2
            live = live[step[live] > 0]
        return done


def runs_of(x: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of ``x`` of ``least`` numbers or more, by start and period.

    Zeros separate: no run holds one. Other numbers are positive.
    """
    if not len(x):
        return (np.zeros(0, np.int64),) * 3
    # A separator of its own at each zero, so that none extends over one.
    apart = x.astype(np.int64).copy()
    zero = np.flatnonzero(x == 0)
    top = int(x.max()) + 1
    apart[zero] = top + np.arange(len(zero))
    ext = Extensions(apart)
    found = []
    for y in (x, np.where(x > 0, top - x, 0)):
        q = lyndon_array(y)
        i = np.flatnonzero(q > 0)
        q = q[i]
        # A run of two periods or more goes on by one number at least to a side of each root.
        j = i + q
        near = np.zeros(len(i), bool)
        right = j < len(x)
        near[right] = apart[i[right]] == apart[j[right]]
        left = i > 0
        near[left] |= apart[i[left] - 1] == apart[j[left] - 1]
        i, j, q = i[near], j[near], q[near]
        a, b = ext.backward(i, j), ext.forward(i, j)
        ok = a + b + q >= np.maximum(2 * q, least)
        found.append(np.stack((i[ok] - a[ok], a[ok] + b[ok] + q[ok], q[ok])))
    s = np.concatenate(found, 1)
    s = s[:, np.lexsort((s[2], s[0]))]
    new = np.ones(s.shape[1], bool)
    new[1:] = (s[0, 1:] != s[0, :-1]) | (s[2, 1:] != s[2, :-1])
    return tuple(s[:, new])


def stretches(h: np.ndarray, doc: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Which words stand in a string of ``gram`` words that occurs more than once in their document."""
    cover = np.zeros(len(h) + 1, np.int64)
    n = len(h) - gram + 1
    if n > 0:
        g = K.window_hashes(h, gram)
        at = np.flatnonzero(doc[:n] == doc[gram - 1 :])
        key = K.mix(g[at] ^ K.mix(doc[at].astype(U64)))
        order = np.argsort(key)
        s = key[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        twice = at[order[same[1:] | same[:-1]]]
        cover[twice] += 1
        np.add.at(cover, twice + gram, -1)
    return np.cumsum(cover)[:-1] > 0


def chunk_runs(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of the runs within documents, by their place; ``h`` are hashes of words."""
    at = np.flatnonzero(stretches(h, doc))
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    rank = np.unique(h[at], return_inverse=True)[1] + 1
    new = np.zeros(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    moved = np.arange(len(at)) + np.cumsum(new)
    x = np.zeros(moved[-1] + 1, np.int64)
    x[moved] = rank
    back = np.zeros(len(x), np.int64)
    back[moved] = at
    start, length, period = runs_of(x)
    return back[start], length, period


def planted(n: int, h: int) -> tuple[int, int] | None:
    """(a, p) if the contract repeats the words of a document of n words: each from a on becomes a + (i - a) mod p."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def find_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Runs of words with a period of each text, and the text without their repeats.

    Words are split at ASCII white space. A run is a stretch of twelve words or more
    that holds its smallest period twice or more and that no neighbour extends. A word
    that any run holds after its first period is dropped. Returns one row per row of
    ``docs``: doc_id; n_runs; start, length, period and exponent_milli of the longest
    run (ties: the first, then the smallest period; without runs null); runs (an array
    of structs by start and period); collapsed (the words kept, joined by a space).

    A null text has no words, an empty one or one of white space neither: no runs, and
    an empty text is left. Texts are taken whole. Repeated rows are taken each, a null
    doc_id is kept; other columns are ignored; an empty table gives no rows. With ``plant``
    words are first repeated as the contract of the query asks, by crc32 of doc_id;
    a row with a null doc_id is then left as it is. Words count as equal by 64 bits of hashes.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, j, buf, off in K.text_chunks(b.column(1)):
                s, e, row = K.words(buf, off, K.NOT_SPACE)
                at = np.searchsorted(row, np.arange(j - i + 1))
                word = np.arange(len(s))
                for k in range(j - i if plant else 0):
                    lo, n = at[k], int(at[k + 1] - at[k])
                    p = None if ids[i + k] is None else planted(n, zlib.crc32(str(ids[i + k]).encode()))
                    if p:
                        word[lo + p[0] : lo + n] = lo + p[0] + np.arange(n - p[0]) % p[1]
                h = K.span_hash(K.prefix_hash(buf), s, e)[word] if len(s) else np.zeros(0, U64)
                first, length, period = chunk_runs(h, row)
                drop = np.zeros(len(s) + 1, np.int64)
                np.add.at(drop, first + period, 1)
                np.add.at(drop, first + length, -1)
                keep = np.cumsum(drop)[:-1] == 0
                of = row[first] if len(first) else first
                edge = np.searchsorted(of, np.arange(j - i + 1))
                raw, cols = buf.tobytes(), [[] for _ in range(7)]
                for k in range(j - i):
                    r = slice(edge[k], edge[k + 1])
                    found = list(zip((first[r] - at[k]).tolist(), length[r].tolist(), period[r].tolist(), strict=True))
                    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
                    own = word[at[k] : at[k + 1]][keep[at[k] : at[k + 1]]]
                    text = b" ".join([raw[p:q] for p, q in zip(s[own].tolist(), e[own].tolist(), strict=True)])
                    values = (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], [dict(zip(("start", "length", "period"), x, strict=True)) for x in found], text)
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                struct = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], struct), pa.array(cols[6], pa.binary()).cast(pa.string())], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    out = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, out)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of all documents, with digests of the runs and of what is left without their repeats."""
    found = find_runs(table(spark, sf_dir, "documents"), plant=True)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
