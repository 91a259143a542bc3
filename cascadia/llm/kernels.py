"""Numpy kernels over Arrow string batches, used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel call takes; a longer text is taken alone.
CHUNK = 1 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word when words are split at ASCII white space only.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of a word of ASCII digits, lower-case letters and non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def text_chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for runs of rows of about ``most`` bytes; null is empty."""
    a = pc.fill_null(texts, "").cast(pa.large_binary())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    off = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for k, b in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            x = np.full(size, U64(b), dtype=U64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters their bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    up, _ = powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=c[1:])
    return c


def span_hash(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes [s, e), from the sums of ``prefix_hash``."""
    _, down = powers(len(c))
    return mix((c[e] - c[s]) * down[s] + (e - s).astype(U64))


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of each row; a word never crosses rows."""
    inside = np.zeros(len(buf) + 1, dtype=bool)
    inside[:-1] = kind[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    before = np.zeros(len(buf) + 1, dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    row = np.searchsorted(off, start, "right") - 1
    return start, end, row


def word_hashes(buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word after lower-casing A-Z."""
    low = LOWER[buf]
    s, e, row = words(low, off, kind)
    return span_hash(prefix_hash(low), s, e), row


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for each i, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    x = mix(h[:n] + U64(k))
    for j in range(1, k):
        x = mix(x * U64(0xD6E8FEB86659FD93) + h[j : j + n])
    return x


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int, kind: np.ndarray = NOT_SPACE) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles.

    A row with some words, but fewer than k, has its whole word sequence as one.
    """
    h, row = word_hashes(buf, off, kind)
    x = window_hashes(h, k)
    n_rows = len(off) - 1
    at = np.searchsorted(row, np.arange(n_rows + 1))
    out = []
    for i in range(n_rows):
        lo, hi = at[i], at[i + 1]
        if hi - lo >= k:
            out.append(np.unique(x[lo : hi - k + 1]))
        elif hi > lo:
            out.append(window_hashes(h[lo:hi], int(hi - lo)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out
