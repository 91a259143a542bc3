"""Plans, outages, draws and studies against plain loops on small tables."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from cascadia.operators import dispatch, grid, placement
from cascadia.sources import artifacts
from pyspark.sql import functions as F

NODES = 7


def components(seed, n=60, mitigation=False):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        members = sorted({int(x) for x in rng.integers(0, NODES, rng.integers(1, 4))})
        rows.append((0.1 * (k % 2), k, float(rng.integers(1, 40)), float(rng.integers(-30, 31)), float(rng.integers(1, 5)) / 8, float(rng.integers(1, 4)), float(rng.integers(1, 3)), members, float(rng.integers(1, 3)) if mitigation else 1.0))
    return rows


NAMES = "co2l double, id int, rot_energy double, power_imbalance double, load_share double, weight double, snapshot_weighting double, members array<int>, mitigation_weighting double"


def brute_plan(rows, energy, rule, steps, limit=1.0, least=0.0, fixed=False, revert=False):
    """The plan of one scenario by the definition, all components anew in each step."""
    comp = [dict(rot=r[2], imb=r[3], share=r[4], w=r[5], sw=r[6], nodes=r[7], m=r[8]) for r in rows]
    rate = lambda c, more=0.0: abs(50 * c["imb"] / (2 * (c["rot"] + more)))
    comp = [c for c in comp if rate(c) > limit]
    added, factor, log, mitigated = np.zeros(NODES), 1.0, [], {}
    for step in range(steps):
        e = factor * energy
        beyond = sum(rate(c) > limit for c in comp)
        if not any(rate(c) > limit and c["share"] > least for c in comp):
            break
        gain = np.zeros(NODES)
        for c in comp:
            if rate(c) > limit and rate(c, e) < limit and c["share"] > least:
                gain[c["nodes"]] += c["share"] * c["w"] * c["m"]
        if not gain.any():
            if fixed:
                break
            factor += 1
            continue
        nodes = np.flatnonzero(np.abs(gain - gain.max()) < 1e-8)
        if len(nodes) > 1 and rule.startswith("hindsight"):
            lost = np.array([sum(c["share"] * c["sw"] for c in comp if n in c["nodes"] and rate(c, e) > limit) for n in nodes])
            nodes = nodes[np.abs(lost - lost.max()) < 1e-8]
        if len(nodes) > 1 and rule.endswith("concentrate"):
            nodes = nodes[np.abs(added[nodes] - added[nodes].max()) < 1e-8]
        n = int(nodes[0])
        log.append((step, n, factor, round(float(gain.max()), 6), beyond))
        added[n] += e
        for c in comp:
            if n in c["nodes"]:
                c["rot"] += e
        if revert:
            factor = 1.0
    return log


@pytest.mark.parametrize("fixed, revert, least", [(False, False, 0.0), (False, True, 0.2), (True, False, 0.0)])
def test_plans_of_all_rules(spark, fixed, revert, least):
    rows = components(1, mitigation=revert)
    df = spark.createDataFrame(rows, NAMES).repartition(3)
    cases = [placement.Case(x, e, r) for x in (0.0, 0.1) for e in (40.0, 160.0) for r in placement.RULES]
    got = placement.place_inertia(df, cases, 7, artifacts.scratch, least_share=least, fixed_step=fixed, revert=revert).collect()
    for k, c in enumerate(cases):
        want = brute_plan([r for r in rows if abs(r[0] - c.scenario) < 1e-9], c.energy, c.rule, 7, least=least, fixed=fixed, revert=revert)
        assert [(r.step, r.node_idx, r.factor, round(r.gain, 6), r.beyond) for r in got if r.case == k] == want
    with pytest.raises(ValueError):
        placement.place_inertia(df, [placement.Case(0.0, 1.0, "best")], 1, artifacts.scratch)


def test_a_plan_ends_when_all_is_mitigated(spark):
    rows = [(0.0, 1, 1.0, 3.0, 0.5, 1.0, 1.0, [2], 1.0), (0.0, 2, 1.0, 0.01, 0.5, 1.0, 1.0, [3], 1.0), (0.0, 3, 1.0, 3.0, 0.5, 1.0, 1.0, [2, 2, 4], 1.0)]
    got = placement.place_inertia(spark.createDataFrame(rows, NAMES), [placement.Case(0.0, 30.0)], 50, artifacts.scratch).collect()
    assert [(r.step, r.node_idx, r.factor, r.gain, r.beyond) for r in got] == [(2, 2, 3.0, 1.0, 2)]
    none = placement.place_inertia(spark.createDataFrame(rows, NAMES).where("false"), [placement.Case(0.0, 30.0)], 5, artifacts.scratch)
    assert none.count() == 0


def test_mitigated_steps(spark):
    rows = [(0.0, 1, 1.0, 4.0, 0.5, 1.0, 1.0, [2, 3], 1.0), (0.0, 2, 1.0, 100.0, 0.5, 1.0, 1.0, [3], 1.0), (0.0, 3, 500.0, 1.0, 0.5, 1.0, 1.0, [3], 1.0), (0.0, 4, 1.0, 3.0, 0.5, 1.0, 1.0, [5], 1.0)]
    plan = spark.createDataFrame([(0.0, 2, 0, 60.0), (0.0, 3, 4, 60.0), (0.0, 3, 6, 60.0), (0.1, 5, 7, 900.0)], "co2l double, node_idx int, step int, energy double")
    got = {r.id: r.mitigated_step for r in placement.mitigated_steps(spark.createDataFrame(rows, NAMES), plan, ["id"]).collect()}
    assert got == {1: 4, 2: -1, 4: -1}


def brute_extension(splits, cost, target):
    left, out = list(splits), []
    while left:
        score = {}
        for s in (1, 2):
            for edge in {r[s] for r in left}:
                own = [r for r in left if r[s] == edge]
                loss, w = sum(r[3] for r in own), sum(r[4] for r in own)
                score[edge] = score.get(edge, 0) + (loss * w if target == "loss" else w)
        best = max(score, key=lambda e: (round(score[e] / cost[e], 9), -e))
        left = [r for r in left if best not in (r[1], r[2])]
        out.append((len(out) + 1, best, round(sum(r[3] * r[4] for r in left), 6), sum(r[4] for r in left)))
    return out


def test_extensions_until_no_split_is_left(spark):
    rng = np.random.default_rng(2)
    rows = [(0.1 * int(rng.integers(2)), int(rng.integers(9)), int(rng.integers(9)), float(rng.integers(1, 9)) / 8, int(rng.integers(1, 4))) for _ in range(150)]
    cost = {e: 1.0 + e % 3 for e in range(9)}
    df = spark.createDataFrame(rows, "co2l double, init_failure_0 int, init_failure_1 int, lost_load_share_blackout double, total_weighting int")
    got = placement.extension_plan(df, spark.createDataFrame(list(cost.items()), "edge int, cost double")).collect()
    for level in (0.0, 0.1):
        for target in ("loss", "weight"):
            own = sorted((r.rank, r.edge, round(r.loss_after, 6), r.weight_after) for r in got if r.target == target and abs(r.co2l - level) < 1e-9)
            assert own == brute_extension([r for r in rows if abs(r[0] - level) < 1e-9], cost, target)


def test_outage_factors_equal_new_solutions(spark):
    """Flows after each outage of a grid with a bridge: as solved without the edge; the bridge splits the grid."""
    rng = np.random.default_rng(3)
    ends = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5), (1, 4), (5, 6)]
    rows = [(k, u, v, float(rng.random() + 0.5), float(rng.integers(1, 4)), 1.0) for k, (u, v) in enumerate(ends)]
    edges = spark.createDataFrame(rows, "edge_idx int, u int, v int, weight double, s_nom double, num_parallel double")
    p = rng.normal(size=(4, 7))
    p -= p.mean(1, keepdims=True)
    t = [dt.datetime(2020, 1, 1 + k) for k in range(4)]
    inj = spark.createDataFrame([(t[k], n, float(p[k, n])) for k in range(4) for n in range(7)], "snapshot timestamp_ntz, node_idx int, p0 double")
    after = {(r.snapshot, r.outage, r.edge_idx): r.flow for r in grid.outage_flows(grid.dc_flows(edges, inj), grid.outage_factors(edges)).collect()}
    checked = {(r.snapshot, r.edge_idx): r for r in grid.n1_check(edges, inj, 0.8).collect()}
    plain = grid.Grid(edges.toPandas())
    for k in range(4):
        for out in range(9):
            r = checked[t[k], out]
            failed, split, _ = plain.cascade(p[k], [(out, 1.0)], 0.8, 1)
            assert (r.n_failed, r.did_split, r.secure) == (len(failed), split, len(failed) <= 1 and not split)
            b = plain.b.copy()
            b[out] = 0
            for e in range(9):
                if split:
                    assert after[t[k], out, e] is None
                else:
                    assert after[t[k], out, e] == pytest.approx(plain.flow(p[k][:, None], b)[e, 0], abs=1e-9)
    assert checked[t[0], 8].did_split and not checked[t[0], 0].did_split


def test_draws_are_reproducible_and_complete(spark):
    hours = [dt.datetime(2021, 1, 1) + dt.timedelta(hours=3 * k) for k in range(8 * 365)]
    times = spark.createDataFrame([(h,) for h in hours], "snapshot timestamp_ntz")
    got = dispatch.drawn_snapshots(times, 3).collect()
    assert len(got) == 3 * 4 * 3 * 4  # realizations, seasons, days, hours
    assert sorted(map(tuple, got)) == sorted(map(tuple, dispatch.drawn_snapshots(times.repartition(5), 3).collect()))
    assert {r.snapshot.hour for r in got} == {6, 12, 18, 0}
    assert all((r.snapshot.weekday() == 6) == (r.day_type == "sunday") and r.snapshot.weekday() != 5 for r in got)
    assert len({frozenset(r.snapshot for r in got if r.realization == k) for k in range(3)}) == 3
    few = dispatch.drawn_snapshots(times.where("snapshot < '2021-01-03'"), 2, weekdays=4)
    assert {(r.season, r.day_type) for r in few.collect()} == {("winter", "weekday")}


def test_a_study_is_resumed(spark, tmp_path):
    cells = spark.createDataFrame([(a, b, c) for a in range(3) for b in range(4) for c in range(5)], "level int, seed int, day int")
    solved = spark.sparkContext.accumulator(0)

    def solve(x):
        rows = x.collect()
        solved.add(len(rows))
        return spark.createDataFrame([(r.level, r.seed, r.day, float(r.level * 100 + r.seed * 10 + r.day)) for r in rows], "level int, seed int, day int, value double")

    keys, root = ["level", "seed", "day"], f"{tmp_path}/study"
    first = artifacts.run_study(cells, keys, root, solve, most_lots=5)
    assert first.count() == 25
    # A lot that is there in part only is solved again, the others aren't.
    spark.read.parquet(f"{root}/level=0/seed=1").where("day < 3").coalesce(1).write.parquet(f"{tmp_path}/part")
    spark.read.parquet(f"{tmp_path}/part").write.mode("overwrite").parquet(f"{root}/level=0/seed=1")
    whole = artifacts.run_study(cells, keys, root, solve)
    assert solved.value == 25 + 60 - 25 + 5
    assert sorted((r.level, r.seed, r.day, r.value) for r in whole.collect()) == [(a, b, c, float(a * 100 + b * 10 + c)) for a in range(3) for b in range(4) for c in range(5)]
    assert artifacts.run_study(cells, keys, root, solve).count() == 60 and solved.value == 65


def test_a_cache_belongs_to_one_network(spark, tmp_path):
    one, other = (spark.createDataFrame([(k, k + d) for k in range(5)], "u int, v int") for d in (1, 2))
    made = []

    def compute(n):
        made.append(1)
        return n.withColumn("w", F.col("v") * 2)

    for n in (one, one.repartition(3), other, one):
        assert artifacts.cached_for(n, str(tmp_path), compute).exceptAll(n.withColumn("w", F.col("v") * 2)).isEmpty()
    assert len(made) == 2


def test_nearest_level_keeps_repeated_rows(spark):
    df = spark.createDataFrame([(0.1, "a"), (0.1, "a"), (0.7, "b")], "co2l double, x string")
    levels = spark.createDataFrame([(0.1 + 1e-8, "p"), (0.4, "q")], "level double, name string")
    assert [tuple(r) for r in artifacts.nearest_level(df, levels).select("x", "name").collect()] == [("a", "p")] * 2


def test_cases_share_the_components(spark):
    """Components are kept once for all cases of a scenario, and a step is one job over them."""
    rng = np.random.default_rng(3)
    rows = [(0.1 * (k % 2), float(x), float(y), float(z), 1.0, 2, [int(n) for n in rng.integers(0, 5, 3)]) for k, (x, y, z) in enumerate(rng.random((60, 3)) + 0.1)]
    df = spark.createDataFrame(rows, "co2l double, rot_energy double, power_imbalance double, load_share double, weight double, snapshot_weighting int, members array<int>")
    kept = []

    def saved(x):
        kept.append(artifacts.scratch(x))
        return kept[-1]

    cases = [placement.Case(level, energy, rule) for level in (0.0, 0.1) for energy in (5.0, 20.0) for rule in placement.RULES]
    assert placement.place_inertia(df, cases, 3, saved).count() > 0
    assert [x.count() for x in kept] == [60]
