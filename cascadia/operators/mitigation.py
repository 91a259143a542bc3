"""Mitigation of severe splits: costs, curves, and greedy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Annuity (5 % over 40 years), line and inertia cost.
RATE, YEARS = 0.05, 40
LINE_COST = 4.5e6
INERTIA_COST = 888.5


def annuity(rate: float = RATE, years: int = YEARS) -> float:
    return rate * (1 + rate) ** years / ((1 + rate) ** years - 1)


def cumulative_cost(log: DataFrame, budget: float) -> DataFrame:
    """Running annual cost of a plan's steps and whether they are within the budget."""
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("cost", F.sum(F.col("investment") * annuity()).over(w)).select("step", "cost", (F.col("cost") <= budget).alias("affordable"))


def mitigation_curve(gains: DataFrame, target: float) -> DataFrame:
    """What is left after each step: the total less the running gain; the first step below the target, else null."""
    total = gains.agg(F.sum("gain").alias("total"))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    c = gains.join(F.broadcast(total)).withColumn("left", F.col("total") - F.sum("gain").over(w))
    first = c.agg(F.min(F.when(F.col("left") < target * F.col("total"), F.col("step"))).alias("first_below"))
    return c.join(F.broadcast(first)).select("step", "left", "first_below")


def severe_curve(s: DataFrame, c: DataFrame, steps: list[int], severe: float = 0.8) -> DataFrame:
    """Weight of severe splits once the components mitigated by each step are taken off."""
    each = c.where("mitigated_step >= 0").withColumn("step", F.explode(F.array(*map(F.lit, steps)))).where("mitigated_step <= step")
    off = each.groupBy("split_number", "step").agg(F.sum("load_share").alias("off"))
    x = s.select("split_number", "lost_load_share_blackout", "total_weighting").withColumn("step", F.explode(F.array(*map(F.lit, steps))))
    left = F.col("lost_load_share_blackout") - F.coalesce("off", F.lit(0.0))
    return x.join(off, ["split_number", "step"], "left").groupBy("step").agg(F.coalesce(F.sum(F.when(left > severe, F.col("total_weighting"))), F.lit(0)).alias("weight"))


def first_within(curve: DataFrame, target: float) -> DataFrame:
    """The first step at which a curve (step, weight) is at the target or below: one row, null if it never is."""
    return curve.agg(F.min(F.when(F.col("weight") <= target, F.col("step"))).alias("first_step"), F.min("weight").alias("least"))


def inertia_scores(c: DataFrame, energy: float, limit: float = 1.0, least_share: float = 0.0) -> DataFrame:
    """Gain of more energy at each node: weight of the components it would bring below the limit."""
    now = F.abs(50.0 * F.col("power_imbalance") / (2 * F.col("rot_energy")))
    then = F.abs(50.0 * F.col("power_imbalance") / (2 * (F.col("rot_energy") + energy)))
    hit = c.where((now > limit) & (then < limit) & (F.col("load_share") > least_share))
    return hit.groupBy("node_idx").agg(F.sum(F.col("load_share") * F.col("trigger_weighting") * F.col("snapshot_weighting")).alias("gain"), F.count("*").alias("n"))


def inertia_sweep(c: DataFrame, limit: float = 1.0) -> DataFrame:
    """The gain at each node of each scenario, for every ``energy`` that the rows of ``c`` bring along: one aggregation for a whole sweep."""
    now = F.abs(50.0 * F.col("power_imbalance") / (2 * F.col("rot_energy")))
    then = F.abs(50.0 * F.col("power_imbalance") / (2 * (F.col("rot_energy") + F.col("energy"))))
    hit = c.where((now > limit) & (then < limit))
    return hit.groupBy("energy", "co2l", "node_idx").agg(F.sum(F.col("load_share") * F.col("trigger_weighting") * F.col("snapshot_weighting")).alias("gain"))


def extension_scores(s: DataFrame, cost: DataFrame) -> DataFrame:
    """Score of each trigger edge: for both sides the sum of losses times the sum of weights, by cost."""
    sides = [s.groupBy(F.col(f"init_failure_{k}").alias("edge")).agg((F.sum("lost_load_share_blackout") * F.sum("total_weighting")).alias("score")) for k in (0, 1)]
    both = sides[0].unionByName(sides[1]).groupBy("edge").agg(F.sum("score").alias("score"))
    return both.join(cost, "edge").select("edge", (F.col("score") / F.col("cost")).alias("score"))
