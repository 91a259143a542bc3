"""Bins and quantities with the conventions of numerical histograms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_index(x: Column, low: float, high: float, n: int) -> Column:
    """Index of the bin of n equal ones over [low, high]; bins are closed on the left, the last on both sides; null outside."""
    width = (high - low) / n
    k = F.floor((x - low) / width)
    return F.when((x >= low) & (x < high), F.least(k, F.lit(n - 1))).when(x == high, n - 1).cast("int")


def edge_bin(x: Column, edges: list[float]) -> Column:
    """Index of the bin between ascending edges, with the same closure; null outside."""
    out = F.when(x == edges[-1], len(edges) - 2)
    for k in range(len(edges) - 1):
        out = out.when((x >= edges[k]) & (x < edges[k + 1]), k)
    return out.cast("int")


def clip_to(x: Column, low: float, high: float) -> Column:
    """The upper edge always clamps, the lower one only if it is 0."""
    y = F.least(x, F.lit(high))
    return F.greatest(y, F.lit(0.0)) if low == 0 else y


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def outside(x: Column, low: float, high: float) -> Column:
    """How many finite values lie outside the edges (an aggregate)."""
    return F.count_if(finite(x) & ((x < low) | (x > high)))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Closeness with a tolerance relative to the second argument."""
    return F.abs(a - b) <= atol + rtol * F.abs(b)
