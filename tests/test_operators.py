"""Hand-computed cases of single operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from cascadia.functions.binning import bin_index, clip_to
from cascadia.operators import clusters, frames, grid, mitigation, planning, splits, vectors
from cascadia.sources import artifacts
from pyspark.sql import functions as F


def frame(u, v, weight=1.0, s_nom=1.0, par=1.0):
    n = len(u)
    return pd.DataFrame({"edge_idx": range(n), "u": u, "v": v, "weight": [weight] * n, "s_nom": [s_nom] * n, "num_parallel": [par] * n})


def test_circuits_step_down():
    assert grid.lost_sizes(2.28947368) == [1.0, 1.0, 0.2894737]
    assert grid.lost_sizes(3.0) == [1.0, 1.0, 1.0]
    with pytest.raises(KeyError):
        grid.lost_sizes(0.1)


def test_double_contingencies(spark):
    one = spark.createDataFrame([(1, 1.0, 2), (2, 1.0, 3)], "line long, size double, weight long")
    for blocks in (1, 2, 8):
        got = {(r.line_0, r.line_1): r.weight for r in grid.double_contingencies(one, blocks).collect()}
        assert got == {(1, 1): 1, (2, 2): 3, (1, 2): 6} and sum(got.values()) == 10


def test_double_contingencies_of_many_lines(spark):
    many = spark.range(40).select(F.col("id").alias("line"), F.lit(1.0).alias("size"), F.lit(1).cast("long").alias("weight"))
    got = [(r.line_0, r.line_1) for r in grid.double_contingencies(many).collect()]
    assert sorted(got) == [(i, j) for i in range(40) for j in range(i + 1, 40)]


def test_lone_lines_of_bridges(spark):
    # A triangle with a tail of two edges, of which one has two lines.
    e = spark.createDataFrame(frame([0, 1, 0, 2, 3], [1, 2, 2, 3, 4]))
    lines = spark.createDataFrame([(i, c) for i, c in enumerate([0, 1, 2, 3, 3, 4])], "line long, corridor int")
    assert [r.line for r in grid.single_lines(lines, e).collect()] == [5]


def test_triangle_flow_and_cascade():
    g = grid.Grid(frame([0, 1, 0], [1, 2, 2]))
    f = g.flow(np.array([[1.0], [-1.0], [0.0]]), g.b)[:, 0]
    assert np.allclose(f, [2 / 3, -1 / 3, 1 / 3])
    tight = grid.Grid(frame([0, 1, 0], [1, 2, 2], s_nom=0.5))
    failed, split, _ = tight.cascade(np.array([1.0, -1.0, 0.0]), [(2, 1.0)])
    assert split and sorted(failed) == [0, 2]


def test_split_before_any_flow():
    failed, split, steps = grid.Grid(frame([0], [1])).cascade(np.array([1.0, -1.0]), [(0, 1.0)])
    assert (failed, split, steps) == ([0], True, 0)


def test_observables(spark):
    c = spark.createDataFrame([(840.0, -20.0, 120.0, 0.5)], "rot_energy_gen double, power_imbalance double, load double, load_share double")
    r = splits.observables(c).first()
    assert abs(r.rocof + 0.5630630) < 1e-6 and abs(r.shedding - 20 / 120 * 0.5) < 1e-12 and r.blackout == 0


def test_bins(spark):
    x = spark.createDataFrame([(v,) for v in (0.0, 20.0, 100.0, 100.00000000000004, 101.0)], "x double")
    got = [r[0] for r in x.select(bin_index(F.col("x"), 0.0, 100.0, 5)).collect()]
    assert got == [0, 1, 4, None, None]
    clipped = [r[0] for r in x.select(bin_index(clip_to(F.col("x"), 0.0, 100.0), 0.0, 100.0, 5)).collect()]
    assert clipped == [0, 1, 4, 4, 4]


def test_distances():
    a, b = np.array([[1.0, 0, 1]]), np.array([[1.0, 1, 0]])
    assert np.isclose(vectors.hamming(a, b)[0, 0], 2 / 3)
    assert vectors.cosine(np.zeros((1, 3)), b)[0, 0] == 1.0
    assert np.isclose(vectors.weighted_hamming(a, a, np.ones((1, 3)), np.ones((1, 3)))[0, 0], 0)


def test_signed_boundary_cancels(spark):
    x = spark.createDataFrame([(1, [0, 1, 0])], "k long, v array<int>")
    e = spark.createDataFrame([(0, 1), (1, 2)], "u int, v int")
    assert vectors.boundary(x, "k", "v", e, steps=0).first().field == [1.0, 0.0, 1.0]
    assert vectors.boundary(x, "k", "v", e, steps=0, signed=False).first().field == [1.0, 1.0, 1.0]


def test_targets_that_are_never_reached(spark):
    g = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 8.0)], "step int, gain double")
    assert {r.first_below for r in mitigation.mitigation_curve(g, 0.0).collect()} == {None}


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(0.1, 1), (0.2, 2)], "co2l double, x int")
    artifacts.write(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        artifacts.write(df, str(tmp_path / "t"))
    assert artifacts.scenarios(spark.read.parquet(str(tmp_path / "t"))) == [0.2, 0.1]
    calls = []
    for _ in range(2):
        out = artifacts.load_or_compute(spark, str(tmp_path / "c"), {"a": 1}, lambda: calls.append(1) or df)
    assert len(calls) == 1 and out.count() == 2
    with pytest.raises(KeyError):
        artifacts.require(df, ["y"])


def test_density_clusters(spark, tmp_path):
    x = {1: 0.0, 2: 0.1, 3: 0.2, 4: 0.35, 5: 5.0, 6: 5.1, 7: 9.0}
    pairs = spark.createDataFrame([(i, j, abs(x[i] - x[j])) for i in x for j in x if i < j], "i long, j long, d double")
    keys = spark.createDataFrame([(i,) for i in x], "key long")
    got = {r.key: (r.cluster, r.core) for r in clusters.dbscan(pairs, keys, 0.16, 3, lambda d: d.checkpoint()).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (2, True), 4: (2, False), 5: (-1, False), 6: (-1, False), 7: (-1, False)}


def test_principal_components(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(50, 3)) * [5, 2, 0.1]
    df = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(50) for j in range(3)], "r long, c int, x double")
    got = clusters.principal_components(df, "r", "c", "x", 2).toPandas().sort_values(["component", "r"])
    c = m - m.mean(0)
    w, v = np.linalg.eigh(c.T @ c)
    first = c @ v[:, -1]
    assert np.allclose(np.abs(got[got.component == 0].score), np.abs(first)) and np.isclose(got[got.component == 1].explained.iloc[0], w[1:].sum() / w.sum())


def test_ac_flow_meets_its_injections():
    y = np.array([[1 - 10j, -1 + 10j, 0], [-1 + 10j, 2 - 20j, -1 + 10j], [0, -1 + 10j, 1 - 10j]])
    p, q = np.array([0.0, -0.5, 0.3]), np.array([0.0, -0.1, 0.0])
    m, a, ok = clusters.ac_flow(y, p, q, np.array([0, 2, 1]), np.zeros(3))
    v = m * np.exp(1j * a)
    s = v * np.conj(y @ v)
    assert ok and np.allclose(s.real[1:], p[1:], atol=1e-6) and np.isclose(s.imag[1], q[1], atol=1e-6) and m[2] == 1


def test_communities_of_two_triangles():
    w = np.zeros((6, 6))
    for a, b in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)):
        w[a, b] = w[b, a] = 1
    assert clusters.modular_communities(w).tolist() == [0, 0, 0, 3, 3, 3]


def test_homogeneity(spark):
    x = spark.createDataFrame([(1, [1, 1, 1, 1]), (2, [0, 1, 0, 1])], "k long, v array<int>")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "u int, v int")
    got = {r.key: r.homogeneity for r in vectors.homogeneity(x, "k", "v", e, (0, 1), depth=2).collect()}
    assert got[1] == [1.0] * 4 and all(0 <= h < 1 for h in got[2])


def test_boundary_steps(spark):
    """A path with one cut edge: half of the own value and half of the neighbours' mean."""
    x = spark.createDataFrame([(1, [1, 1, 0, 0])], "k long, v array<int>")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "u int, v int")
    assert vectors.boundary(x, "k", "v", e, steps=1).first().field == [0.5, 0.75, 0.75, 0.5]
    assert vectors.boundary(x, "k", "v", e, alpha=0.5, steps=2).first().field == [0.625, 0.6875, 0.6875, 0.625]


def test_homogeneity_by_hand(spark):
    """Path of three: node 0 sees node 1 at one step; at two steps itself and node 2."""
    x = spark.createDataFrame([(1, [1, 0, 0])], "k long, v array<int>")
    e = spark.createDataFrame([(0, 1), (1, 2)], "u int, v int")
    got = vectors.homogeneity(x, "k", "v", e, (0, 1), depth=2, decay=1.0, measure="gini").first().homogeneity
    # Node 0: class 0 has 1 + 1/4 of 3/2, class 1 has 1/4. Node 1: 1/2 and 1/2, then itself: 1/2.
    assert got == pytest.approx([(5 / 6) ** 2 + (1 / 6) ** 2, (2 / 3) ** 2 + (1 / 3) ** 2, (5 / 6) ** 2 + (1 / 6) ** 2])
    katz = vectors.typed_katz(x, "k", "v", e, depth=2, decay=1.0).first().katz
    assert katz == pytest.approx([1.0, 0.5, 1.0])


def test_balanced_accuracy_and_overlap():
    a, b = np.array([[1, 1, 0, -1]]), np.array([[1, 0, 0, -1]])
    u, v = np.array([[1.0, 2.0, 1.0, 1.0]]), np.array([[3.0, 1.0, 1.0, 1.0]])
    # Class 1: 4 of 3 + 3; class 0: 2 of 1 + 2; class -1: all.
    assert vectors.balanced_accuracy((-1, 0, 1))(a, b, u, v)[0, 0] == pytest.approx((1 - 0.666667 + 1 - 0.666667) / 3)
    # Non-zero: 3 + 1 of 4 + 4; zero: 1 of 1 + 2.
    assert vectors.balanced_overlap(a, b, u, v)[0, 0] == pytest.approx(1 - (4 / 8 + 1 / 3) / 2)


def test_edge_order(spark):
    e = spark.createDataFrame([(0, 0, 1), (1, 2, 1), (2, 1, 2), (3, 2, 3)], "edge_idx int, u int, v int")
    assert tuple(planning.order_faults(e).first()) == (1, 2, 4)


def test_snapshots_by_label_and_position(spark):
    t = spark.createDataFrame([(f"2024-01-0{k}",) for k in (1, 2, 2, 3)], "snapshot string").select(F.to_date("snapshot").alias("snapshot"))
    day = lambda df: sorted(str(r[0])[-1] for r in df.collect())
    assert day(frames.snapshots_by(t)) == ["1", "2", "3"] and day(frames.snapshots_by(t, [0, -1])) == ["1", "3"]
    assert day(frames.snapshots_by(t, ["2024-01-02"])) == ["2"]
    for wrong in ([7], ["2024-02-01"]):
        with pytest.raises(ValueError):
            frames.snapshots_by(t, wrong)


def test_partition_and_progress(spark):
    w = spark.createDataFrame([(1, 2.5), (2, 0.3)], "id int, weight double")
    assert {r.id: r.c for r in planning.partition(w, (1.0, 0.5, 0.25)).collect()} == {1: [0, 0, 10], 2: None}
    log = spark.createDataFrame([(0, 3, 5.0), (1, 4, 3.0), (2, 3, 1.0)], "step int, node_idx int, gain double")
    assert {r.node_idx: r.energy for r in planning.inertia_until(log, 10.0, 0.4, 10.0).collect()} == {3: 10.0, 4: 10.0}


def test_geodesic_and_components_less_the_main_one(spark):
    x = spark.range(1).select(planning.geodesic(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("km")).first().km
    assert x == pytest.approx(6371.0088 * np.pi / 2)
    v = spark.createDataFrame([(1, [2, 2, 5, 7, 7])], "k int, v array<int>")
    assert {r.value: r.v for r in planning.component_vectors(v, "k", "v").collect()} == {5: [0, 0, 1, 0, 0], 7: [0, 0, 0, 1, 1]}


def test_bus_types_count_all_buses(spark):
    cap = spark.createDataFrame([(1, 5.0), (1, 4.0), (2, 8.0), (3, 1.0), (4, 0.0)], "bus int, p_nom double")
    got = {r.bus: r.kind for r in grid.bus_types(cap, spark.range(1, 11).withColumnRenamed("id", "bus")).collect()}
    assert {k: v for k, v in got.items() if v != "PQ"} == {1: "Slack", 2: "PV", 3: "PV"} and len(got) == 10
    pf = {r.bus: r for r in grid.power_factors(grid.bus_types(cap, spark.range(1, 11).withColumnRenamed("id", "bus"))).collect()}
    assert pf[1].factor is None and pf[1].tangent == 0 and all(0.925 <= pf[k].factor <= 0.975 for k in range(4, 11))


def test_cascade_margin_and_limits():
    g = grid.Grid(frame([0, 1, 0], [1, 2, 2], s_nom=2 / 3 / (1 + 5e-5)))
    assert g.cascade(np.array([1.0, -1.0, 0.0]), []) == ([], False, 0)  # within the margin of 1e-4
    with pytest.raises(ValueError):
        g.cascade(np.array([1.0, -1.0, 0.0]), [(0, 2.0)])


def test_edge_likelihood_by_hand(spark):
    s = spark.createDataFrame([(1, 2, 0, 0), (2, 3, 1, 2)], "split_number long, total_weighting long, init_failure_0 int, init_failure_1 int")
    failed = spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "split_number long, edge int")
    norm = spark.createDataFrame([(0.0, 6.0), (0.1, 4.0)], "co2l double, norm double")
    got = {r.edge: (r.secondary, r.primary, r.total) for r in splits.edge_likelihood(s, failed, spark.range(4).selectExpr("int(id) edge"), norm).collect()}
    assert got == {0: (0, 0.4, 0.4), 1: (0.5, 0.3, 0.5), 2: (0, 0.3, 0.3), 3: (0, 0, 0)}


def test_ranks_of_a_large_group(spark):
    from cascadia.functions.ranks import ranked

    df = spark.range(3000).selectExpr("id % 2 as g", "id * 7919 % 1000 as x", "id")
    got = ranked(df, "g", F.col("x"), ["id"], 16).collect()
    for g in (0, 1):
        order = sorted((r.x, r.id) for r in got if r.g == g)
        assert {(r.x, r.id): (r["rank"], r.group_rows) for r in got if r.g == g} == {k: (i + 1, 1500) for i, k in enumerate(order)}


@pytest.mark.parametrize("run", [vectors.boundary, lambda *a: vectors.homogeneity(*a, (0, 1))])
def test_vectors_beyond_the_grid_are_refused(spark, run):
    x = spark.createDataFrame([(1, [0, 1, 0, 1])], "k long, v array<int>")
    e = spark.createDataFrame([(0, 1), (1, 2)], "u int, v int")
    with pytest.raises(Exception, match="3 positions"):
        run(x, "k", "v", e).collect()


def test_every_contingency_at_every_snapshot(spark):
    e = spark.createDataFrame(frame([0, 1, 0], [1, 2, 2], par=2.0))
    p = spark.sql("SELECT timestamp_ntz'2024-01-01' + make_interval(0, m) AS snapshot, n AS node_idx, CASE n WHEN 0 THEN 1.0D WHEN 1 THEN -1.0D ELSE 0D END * (1 + m) AS p0 FROM (SELECT explode(array(0, 1)) AS m), (SELECT explode(array(0, 1, 2)) AS n)")
    pairs = spark.createDataFrame([(0, 1.0, 0, 1.0, 1.0), (0, 1.0, 1, 1.0, 4.0), (2, 1.0, 2, 1.0, 1.0)], "line_0 int, size_0 double, line_1 int, size_1 double, weight double")
    got = {(r.snapshot.month, r.line_0, r.line_1): (r.failed_edges, r.did_split) for r in grid.cascades(e, p, pairs, 10.0).collect()}
    # Both circuits of one line are gone, not one of them.
    assert got == {(m, a, b): ([a] if a == b else [], False) for m in (1, 2) for a, b in ((0, 0), (0, 1), (2, 2))}


def test_overloads_within_the_margin_hold():
    p = np.array([1.0, -1.0, 0.0])
    for over, fails in ((5e-5, False), (2e-4, True)):
        g = grid.Grid(frame([0, 1, 0], [1, 2, 2], s_nom=2 / 3 / (1 + over)))
        assert bool(g.cascade(p, [])[0]) == fails


def test_dbscan_of_rows_that_stand_for_several(spark):
    """Keys with a number of equal rows give the clusters of the whole table; far pairs never leave their tile."""
    rng = np.random.default_rng(4)
    few = np.unique(rng.integers(0, 2, (14, 6)), axis=0)
    v = few[rng.integers(0, len(few), 40)]
    x = spark.createDataFrame([(k, z.tolist()) for k, z in enumerate(v)], "key long, v array<int>")
    pairs = spark.createDataFrame([(i, j, float((v[i] != v[j]).mean())) for j in range(40) for i in range(j)], "i long, j long, d double")
    keep = lambda d: d.checkpoint()
    first = {k: min(j for j in range(40) if (v[j] == v[k]).all()) for k in range(40)}
    u = x.where(F.col("key").isin(sorted(set(first.values())))).withColumn("rows", F.element_at(F.create_map(*[F.lit(y) for k in set(first.values()) for y in (k, sum(f == k for f in first.values()))]), F.col("key").cast("int")))
    near = vectors.blocked_pairs(u, "key", "v", None, vectors.hamming, most=0.2)
    assert near.where("d > 0.2").isEmpty()
    for least in (1, 3, 5, 8):
        want = {r.key: (r.cluster, r.core) for r in clusters.dbscan(pairs, x.select("key"), 0.2, least, keep).collect()}
        got = {r.key: (r.cluster, r.core) for r in clusters.dbscan(near, u.select("key", "rows"), 0.2, least, keep).collect()}
        assert {k: got[f] for k, f in first.items()} == want


def test_double_contingencies_are_dealt_by_number(spark, monkeypatch):
    """More lines make more pairs of blocks, and no task forms a large part of the pairs; equal lines of two sizes count as well."""
    monkeypatch.setattr(grid, "PAIRED", 10)
    rows = [(k, z, 1 + k % 2) for k in range(100) for z in (1.0, 0.5)]
    many = spark.createDataFrame(rows, "line long, size double, weight long").coalesce(1)
    out = grid.double_contingencies(many)
    per_task = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(per_task) == 200 * 199 // 2 + 100 and max(per_task) < sum(per_task) / 10
    got = {(r.line_0, r.size_0, r.line_1, r.size_1): r.weight for r in out.collect()}
    ends = sorted((k, z, w) for k, z, w in rows)
    want = {(a[0], a[1], b[0], b[1]): a[2] * b[2] for i, a in enumerate(ends) for b in ends[i + 1 :]} | {(k, z, k, z): 1 for k, z, w in ends if w == 2}
    assert got == want
