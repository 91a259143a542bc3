"""Communities: never worse than greedy merging, always connected."""

from __future__ import annotations

import numpy as np
import pytest
from cascadia.operators import communities as C
from cascadia.sources.artifacts import scratch


def greedy(w):
    """Modularity of merging the best pair of communities while it gains."""
    n, total = len(w), w.sum()
    label = np.arange(n)
    e, a = w / total, w.sum(1) / total
    while True:
        gain = np.where(e > 0, 2 * (e - np.outer(a, a)), -np.inf)
        np.fill_diagonal(gain, -np.inf)
        i, j = sorted(np.unravel_index(np.argmax(gain), gain.shape))
        if gain[i, j] <= 1e-12:
            return label
        e[i] += e[j]
        e[:, i] += e[:, j]
        e[j], e[:, j] = 0, 0
        a[i] += a[j]
        a[j] = 0
        label[label == j] = i


def quality(w, label):
    k = w.sum(1)
    return float(((w - np.outer(k, k) / w.sum()) * (np.asarray(label)[:, None] == np.asarray(label))).sum() / w.sum())


def graph(seed, groups, size, inside, outside):
    rng = np.random.default_rng(seed)
    n = groups * size
    of = np.arange(n) // size
    p = np.where(of[:, None] == of, inside, outside)
    w = np.triu((rng.random((n, n)) < p) * rng.integers(1, 5, (n, n)), 1).astype(float)
    return w + w.T


def test_communities_are_good_and_connected(spark):
    graphs = [graph(1, 3, 5, 0.9, 0.05), graph(2, 2, 5, 0.5, 0.3), graph(3, 1, 10, 0.3, 0.0)]
    rows = [(g, int(u), int(v), float(w[u, v])) for g, w in enumerate(graphs) for u, v in zip(*np.nonzero(np.triu(w)), strict=True)]
    edges = spark.createDataFrame(rows + [(9, 1, 2, 0.0), (10, 5, 7, 2.0)], "g int, u long, v long, w double")
    got = scratch(C.leiden(edges, scratch))
    q = {r.g: (r.communities, r.modularity) for r in C.modularity(edges, got).collect()}
    at = {(r.g, r.node): r.community for r in got.collect()}
    assert (9, 1) not in at and at[10, 5] == at[10, 7] == 5
    for g, w in enumerate(graphs):
        nodes = np.flatnonzero(w.sum(1))
        label = np.array([at.get((g, n), -1 - n) for n in range(len(w))])
        assert q[g][1] == pytest.approx(quality(w, label)) and q[g][0] == len(set(label[nodes]))
        assert q[g][1] >= quality(w, greedy(w)) - 1e-9
        for c in set(label[nodes]):
            own = np.flatnonzero(label == c)
            assert c == own.min()
            seen, rest = {own[0]}, [own[0]]
            while rest:
                x = rest.pop()
                more = [y for y in own if w[x, y] > 0 and y not in seen]
                seen |= set(more)
                rest += more
            assert len(seen) == len(own)
    assert len({at[0, n] for n in range(15)}) == 3 and all(len({at[0, n] for n in range(5 * k, 5 * k + 5)}) == 1 for k in range(3))


def test_split_of_what_does_not_hang_together(spark):
    e = C.symmetric(spark.createDataFrame([(0, 1, 2, 1.0), (0, 3, 4, 1.0), (0, 2, 5, 1.0)], "g int, u long, v long, w double"))
    at = spark.createDataFrame([(0, n, 1) for n in (1, 2, 3, 4)] + [(0, 5, 5)], "g int, node long, c long")
    assert {r.node: r.community for r in C.hanging_together(e, at, scratch).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
