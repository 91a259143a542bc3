"""Greedy plans over whole tables of components and splits, for many cases at once.

A case is a scenario with a step size and a rule for ties. All cases advance in one job
a step, which reads each component once and takes it through the cases of its scenario: gains of nodes
are whole parts of a billion, so that sums don't depend on the order of tasks and a gain of nothing is
exactly nothing. What comes to the driver has a row for each case and node of the grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gains are sums of whole parts of this size; gains that differ by less than TIE count as equal.
PART, TIE = 1e-9, 1e-8
RULES = ("smallest", "concentrate", "hindsight", "hindsight_concentrate")
#: Pseudo-nodes of the sums: components beyond the limit, and those of them that may still be mitigated.
BEYOND, OPEN = -1, -2


@dataclass
class Case:
    """State of one plan: step size, factor, energy and gains by node."""

    scenario: float
    energy: float
    rule: str = "smallest"
    factor: float = 1.0
    added: dict[int, float] = field(default_factory=dict)
    gains: dict[int, int] = field(default_factory=dict)
    log: list[tuple] = field(default_factory=list)
    done: bool = False

    @property
    def step_energy(self) -> float:
        return self.factor * self.energy


def _rate(imbalance: Column, energy: Column) -> Column:
    return F.abs(50.0 * imbalance / (2 * energy))


def _sums(rows: DataFrame, cases: dict[int, tuple[int, Case]], limit: float, least_share: float) -> DataFrame:
    """(case, node, n, lost) with the cases' present state, summed by task.

    ``n`` are gains of nodes and counts of components, ``lost`` is the load still lost in a node's components after
    the next step there, weighted by their snapshots. ``cases`` has the scenario's number and the case by the case's number.
    """
    states = [(k, level, dict(c.added), c.step_energy) for k, (level, c) in cases.items()]

    def rate(imbalance: np.ndarray, energy: np.ndarray) -> np.ndarray:
        return np.abs(50.0 * imbalance / (2 * energy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}

        def add(case: int, nodes: np.ndarray, sums: np.ndarray, which: int) -> None:
            for node, x in zip(nodes.tolist(), sums.tolist(), strict=True):
                if x:
                    total.setdefault((case, node), [0, 0])[which] += x

        for batch in batches:
            level, whole, lost, energy, imbalance, share = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("level", "whole", "lost", "rot_energy", "power_imbalance", "load_share"))
            members = batch.column("members")
            nodes, at = np.unique(members.flatten().to_numpy(), return_inverse=True)
            of = np.repeat(np.arange(len(batch)), members.value_lengths().to_numpy())
            for here in np.unique(level):
                mine = np.flatnonzero(level == here)
                place = np.full(len(batch), -1)
                place[mine] = np.arange(len(mine))
                pick = place[of] >= 0
                row, node = place[of][pick], at[pick]  # members of this scenario's components
                e, i, s, w, z = energy[mine], imbalance[mine], share[mine], whole[mine], lost[mine]
                for k, own, added, step in states:
                    if own != here:
                        continue
                    now = e + np.bincount(row, np.array([added.get(n, 0.0) for n in nodes.tolist()])[node], len(mine)) if added else e + 0.0
                    then = rate(i, now + step)
                    beyond = rate(i, now) > limit
                    eligible = beyond & (s > least_share)
                    gains = eligible & (then < limit)
                    for hit, value, which in ((gains, w, 0), (then > limit, z, 1)):
                        sums, there = np.zeros(len(nodes), np.int64), hit[row]
                        np.add.at(sums, node[there], value[row[there]])
                        add(k, nodes, sums, which)
                    add(k, np.array([BEYOND, OPEN]), np.array([beyond.sum(), eligible.sum()]), 0)
        rows = [(k, n, x, y) for (k, n), (x, y) in total.items()]
        case, node, n, lost = (list(z) for z in zip(*rows, strict=True)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(case, pa.int32()), pa.array(node, pa.int32()), pa.array(n, pa.int64()), pa.array(lost, pa.int64())], ["case", "node", "n", "lost"])

    return rows.mapInArrow(run, "case int, node int, n long, lost long")


def _pick(case: Case, nodes: list[int], lost: dict[int, float] | None) -> int:
    """The node that the case's rule takes of equally good ones; what it leaves open goes to the smallest."""
    if case.rule.startswith("hindsight") and lost is not None:
        most = max(lost.get(n, 0.0) for n in nodes)
        nodes = [n for n in nodes if abs(lost.get(n, 0.0) - most) < TIE]
    if case.rule.endswith("concentrate"):
        most = max(case.added.get(n, 0.0) for n in nodes)
        nodes = [n for n in nodes if abs(case.added.get(n, 0.0) - most) < TIE]
    return min(nodes)


def place_inertia(components: DataFrame, cases: list[Case], steps: int, saved, limit: float = 1.0, least_share: float = 0.0, fixed_step: bool = False, revert: bool = False) -> DataFrame:
    """Plans of inertia: case, co2l, energy, rule, step, node_idx, factor, gain, beyond.

    ``components`` has co2l, rot_energy, power_imbalance, load_share, weight,
    snapshot_weighting and members, the nodes of each component; a column
    mitigation_weighting counts into gains where it is given. In each step every case
    puts its energy at the node where it brings the greatest weighted load of
    components from beyond the limit to below it. Where no node gains, the step grows
    by the energy (it ends instead if ``fixed_step``; it shrinks back after each placement if
    ``revert``). Ties go by rule: to the smallest node, to where most energy
    stands, to where most load would still be lost, or by both of these. A case
    ends once nothing is left to mitigate. ``beyond`` counts components beyond the limit before the step.
    """
    for c in cases:
        if c.rule not in RULES:
            raise ValueError(f"unknown rule {c.rule}")
    spark = components.sparkSession
    weight = F.col("weight") * (F.col("mitigation_weighting") if "mitigation_weighting" in components.columns else F.lit(1.0))
    levels = sorted({float(c.scenario) for c in cases})
    of = spark.createDataFrame(list(enumerate(levels)), "level int, scenario double")
    rows = components.where(_rate(F.col("power_imbalance"), F.col("rot_energy")) > limit).join(F.broadcast(of), F.abs(F.col("co2l") - F.col("scenario")) < 1e-9)
    part = lambda w: F.coalesce(F.round(F.col("load_share") * w / PART).cast("long"), F.lit(0))
    rows = saved(rows.select("level", F.col("rot_energy").cast("double").alias("rot_energy"), F.col("power_imbalance").cast("double").alias("power_imbalance"), F.col("load_share").cast("double").alias("load_share"), part(weight).alias("whole"), part(F.col("snapshot_weighting")).alias("lost"), F.array_distinct("members").cast("array<int>").alias("members")))
    for step in range(steps):
        open_cases = {k: (levels.index(float(c.scenario)), c) for k, c in enumerate(cases) if not c.done}
        if not open_cases:
            break
        lost: dict[int, dict[int, float]] = {k: {} for k in open_cases}
        for _, c in open_cases.values():
            c.gains = {}
        for r in _sums(rows, open_cases, limit, least_share).groupBy("case", "node").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")).collect():
            if r["n"]:
                cases[r["case"]].gains[r["node"]] = r["n"]
            lost[r["case"]][r["node"]] = r["lost"] * PART
        for k, (_, c) in open_cases.items():
            best = max((v for n, v in c.gains.items() if n >= 0), default=0)
            if not c.gains.get(OPEN, 0) or (best <= 0 and fixed_step):
                c.done = True
            elif best <= 0:
                c.factor += 1
            else:
                tied = [n for n, v in c.gains.items() if n >= 0 and (best - v) * PART < TIE]
                node = _pick(c, tied, lost[k] if len(tied) > 1 and c.rule.startswith("hindsight") else None)
                c.log.append((k, float(c.scenario), float(c.energy), c.rule, step, node, c.factor, c.gains[node] * PART, c.gains.get(BEYOND, 0)))
                c.added[node] = c.added.get(node, 0.0) + c.step_energy
                if revert and c.factor > 1:
                    c.factor = 1.0
    log = [x for c in cases for x in c.log]
    return spark.createDataFrame(log, "case int, co2l double, energy double, rule string, step int, node_idx int, factor double, gain double, beyond long")


def mitigated_steps(components: DataFrame, plan: DataFrame, keys: list[str], limit: float = 1.0) -> DataFrame:
    """The step of a plan that brings each component below the limit: keys, mitigated_step, -1 if none does.

    ``plan`` has co2l, step, node_idx and energy, the energy of the step; components within the limit from
    the start are left out. Energy only grows, so the first step with enough of it at the members counts.
    """
    far = components.where(_rate(F.col("power_imbalance"), F.col("rot_energy")) > limit)
    each = far.select(*keys, "co2l", "rot_energy", "power_imbalance", F.explode(F.array_distinct("members")).alias("node_idx")).join(F.broadcast(plan.select("co2l", "node_idx", "step", "energy")), ["co2l", "node_idx"])
    at = each.withColumn("now", F.col("rot_energy") + F.sum("energy").over(Window.partitionBy(*keys).orderBy("step")))
    first = at.where(_rate(F.col("power_imbalance"), F.col("now")) < limit).groupBy(*keys).agg(F.min("step").alias("mitigated_step"))
    return far.select(*keys).join(first, keys, "left").select(*keys, F.coalesce("mitigated_step", F.lit(-1)).alias("mitigated_step"))


def extension_plan(splits: DataFrame, cost: DataFrame, targets: tuple[str, ...] = ("weight", "loss")) -> DataFrame:
    """Whole plans of line extensions: target, co2l, rank, edge, cost, loss_after, weight_after.

    The edge with the best score by cost is extended, the splits that it triggers
    go, and so on until none is left. For target ``loss`` the score sums, over both sides of the trigger pair, loss times
    weight (of sums); for ``weight`` the weights. Splits are aggregated by trigger pair
    first: a scenario's greedy steps run in a task over a table that the grid bounds,
    and an extension takes the sums of its pairs back from the partner edges. Ties go to the smaller edge.
    """
    pair = splits.groupBy("co2l", F.col("init_failure_0").alias("e0"), F.col("init_failure_1").alias("e1")).agg(F.sum("lost_load_share_blackout").alias("loss"), F.sum("total_weighting").cast("double").alias("weight"), F.sum(F.col("lost_load_share_blackout") * F.col("total_weighting")).alias("both"))
    prices = F.broadcast(cost.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("edge", "cost"))).alias("prices")))
    dealt = pair.join(prices).withColumn("target", F.explode(F.array(*map(F.lit, targets))))

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        level, target = key
        prices = x["prices"].iloc[0]
        x = x.sort_values(["e0", "e1"])
        e, loss, weight, both = x[["e0", "e1"]].to_numpy(int), *(x[c].to_numpy(float) for c in ("loss", "weight", "both"))
        n = max(max(prices), int(e.max())) + 1
        price = np.array([prices.get(k, np.inf) for k in range(n)])
        live, out = np.ones(len(e), bool), []
        sums = [[np.bincount(e[:, s], v, n) for v in (loss, weight)] for s in (0, 1)]
        count = np.bincount(e[:, 0], minlength=n) + np.bincount(e[:, 1], minlength=n)
        while live.any():
            score = sum(s[0] * s[1] if target == "loss" else s[1] for s in sums) / price
            score = np.where(count > 0, np.round(score, 9), -1.0)
            k = int(score.argmax())
            if count[k] <= 0:
                break
            gone = live & ((e[:, 0] == k) | (e[:, 1] == k))
            live &= ~gone
            for s in (0, 1):  # retraction from both ends of what goes
                np.add.at(count, e[gone, s], -1)
                for v, w in zip(sums[s], (loss, weight), strict=True):
                    v -= np.bincount(e[gone, s], w[gone], n)
                    v[count == 0] = 0.0
            out.append((target, level, len(out) + 1, k, price[k], both[live].sum(), weight[live].sum()))
        return pd.DataFrame(out, columns=["target", "co2l", "rank", "edge", "cost", "loss_after", "weight_after"])

    return dealt.groupBy("co2l", "target").applyInPandas(run, "target string, co2l double, rank int, edge int, cost double, loss_after double, weight_after double")


def affordable(plan: DataFrame, budgets: list[float]) -> DataFrame:
    """The last step of each scenario's plan within each budget: co2l, budget, last_step, -1 if none is."""
    total = plan.withColumn("total", F.sum("cost").over(Window.partitionBy("co2l").orderBy("step")))  # a row for each step of a plan
    each = total.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    return each.groupBy("co2l", "budget").agg(F.coalesce(F.max(F.when(F.col("total") <= F.col("budget"), F.col("step"))), F.lit(-1)).alias("last_step"))


def replay(components: DataFrame, plan: DataFrame, budgets: list[float]) -> DataFrame:
    """Splits after a plan is carried out within each budget: budget, co2l, time_stamp, split_number, lost_load_share_blackout, load, total_weighting.

    ``components`` has mitigated_step (-1: never), blackout, load and weights. All budgets
    are one aggregation: a component's loss counts where its step isn't within the budget.
    """
    until = affordable(plan, budgets).groupBy("co2l").agg(F.collect_list(F.struct("budget", "last_step")).alias("until"))
    each = components.join(F.broadcast(until), "co2l").withColumn("b", F.explode("until"))
    done = (F.col("mitigated_step") >= 0) & (F.col("mitigated_step") <= F.col("b.last_step"))
    return each.groupBy(F.col("b.budget").alias("budget"), "co2l", "time_stamp", "split_number").agg(F.sum(F.when(done, 0.0).otherwise(F.col("blackout"))).alias("lost_load_share_blackout"), F.sum("load").alias("load"), F.min(F.col("trigger_weighting") * F.col("snapshot_weighting")).cast("long").alias("total_weighting"))


def severe(splits: DataFrame, by: list[str], share: float = 0.8) -> DataFrame:
    """Splits that lose ``share`` of the load or more: their number and weight."""
    hit = F.round("lost_load_share_blackout", 9) >= share
    return splits.groupBy(*by).agg(F.count_if(hit).alias("n"), F.coalesce(F.sum(F.when(hit, F.col("total_weighting"))), F.lit(0)).alias("weight"))
