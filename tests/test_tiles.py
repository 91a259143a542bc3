"""Distances of vectors in tiles against brute force, and what the queries over them shuffle."""

from __future__ import annotations

import contextlib
import io

import __spark_entry__ as entry
import numpy as np
import pyarrow as pa
import pytest
from cascadia.operators import vectors as V

SF = "/root/testdata/sf0.001"


def vectors(spark, n, width=6, seed=0):
    r = np.random.default_rng(seed)
    v, w = r.integers(-1, 2, (n, width)), r.random((n, width)) + 0.1
    keys = r.permutation(3 * n)[:n].tolist()
    rows = [(k, a.tolist(), b.tolist()) for k, a, b in zip(keys, v, w, strict=True)]
    return spark.createDataFrame(rows, "key long, v array<int>, w array<double>"), np.array(keys), v.astype(float), w


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def small(monkeypatch):
    """Blocks so small that a few rows make several; workers keep their own SIDE."""
    for name, value in (("LEAST_BLOCK", 8), ("BLOCK", 24), ("BLOCKS", 3)):
        monkeypatch.setattr(V, name, value)


def test_tiles_hold_blocks_of_bounded_number(spark, small):
    x, *_ = vectors(spark, 60)

    def run(p, q, same):
        yield pa.RecordBatch.from_pydict({"n": [len(p.key) * (1 if same else len(q.key))]})

    # Three blocks for 60 rows of 24 a block at most, not one for each LEAST_BLOCK rows.
    assert V.tiled(x, "key", "v", None, run, "n long", 24).count() <= 6


@pytest.mark.parametrize("mean", [V.geometric_similarity, V.root_of_product, V.harmonic_mean])
def test_means_of_two_distances_in_one_tile(spark, small, mean):
    x, keys, v, w = vectors(spark, 40)
    got = {(r.i, r.j): r.d for r in V.blocked_pairs(x, "key", "v", "w", V.joint(mean, V.hamming, V.cosine), tile=24).collect()}
    d = mean(V.hamming(v, v), V.cosine(w, w))
    want = {(min(keys[a], keys[b]), max(keys[a], keys[b])): d[a, b] for a in range(40) for b in range(a)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


@pytest.mark.parametrize("name", ["composite_pairs", "harmonic_pairs", "product_root_pairs"])
def test_means_take_no_join_of_pairs(spark, name):
    assert "Join" not in plan(entry.queries()[name](spark, SF))


DISTANCES = {
    # name: distance, vectors, weights
    "hamming_pairs": (V.hamming, "v", None),
    "class_distance_pairs": (V.class_distance, "v", None),
    "whamming_pairs": (V.weighted_hamming, "v", "w"),
    "cosine_pairs": (V.cosine, "w", None),
    "balanced_overlap_pairs": (V.balanced_overlap, "v", "w"),
    "bacc_pairs": (V.balanced_accuracy((-1, 0, 1)), "v", "w"),
}


@pytest.mark.parametrize("name", sorted(DISTANCES))
def test_distances_in_tiles(spark, small, name):
    distance, vector, weight = DISTANCES[name]
    x, keys, v, w = vectors(spark, 50, seed=1)
    of = {"v": v, "w": w, None: None}
    got = {(r.i, r.j): r.d for r in V.blocked_pairs(x, "key", vector, weight, distance, tile=24, digits=8).collect()}
    d = distance(of[vector], of[vector], of[weight], of[weight])
    assert len(got) == 50 * 49 // 2
    for a in range(50):
        for b in range(a):
            assert got[min(keys[a], keys[b]), max(keys[a], keys[b])] == pytest.approx(d[a, b], abs=6e-9)


@pytest.mark.parametrize("most", [1_024, 2])
def test_silhouettes_without_pairs(spark, small, monkeypatch, most):
    """Those of the table of pairs, with lone, single and missing labels; too many labels take the pairs."""
    monkeypatch.setattr(V, "LABELS", most)
    x, *_ = vectors(spark, 40, width=8)
    for label in ("key % 4", "if(key % 3 = 0, null, if(key > 100, 7, key % 2))", "1", "key"):
        y = x.selectExpr("key", "v", f"cast({label} as int) as label")
        want = V.silhouette(V.blocked_pairs(y, "key", "v", None, V.hamming), y.select("key", "label"))
        ordered = lambda df: sorted((r.i, -1 if r.label is None else r.label, round(r.silhouette, 9)) for r in df.collect())
        assert ordered(V.hamming_silhouette(y, "key", "v", "label")) == ordered(want)
    assert V.hamming_silhouette(x.limit(1).selectExpr("key", "v", "1 as label"), "key", "v", "label").count() == 0


@pytest.mark.parametrize("name", ["silhouette", "result_index", "best_results"])
def test_scores_take_no_pairs(spark, name):
    assert "FlatMapGroups" not in plan(entry.queries()[name](spark, SF))


def test_squares_cover_each_pair_once(monkeypatch):
    """Without a session: workers import the module anew and keep its own SIDE."""
    monkeypatch.setattr(V, "SIDE", 5)
    block = lambda keys: V.Block(np.array(keys), np.zeros((len(keys), 1)), np.zeros((len(keys), 1)))
    p, q = block(range(0, 46, 2)), block(range(1, 35, 2))
    for a, b, same in ((p, q, False), (p, p, True)):
        got = [(i, j) for x, y, keep in V.squares(a, b, same) for r, i in enumerate(x.key.tolist()) for s, j in enumerate(y.key.tolist()) if keep is None or keep[r, s]]
        want = [(i, j) for i in a.key.tolist() for j in b.key.tolist() if not same or i < j]
        assert sorted(got) == want
