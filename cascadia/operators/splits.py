"""Risk of system splits: observables of components, rollups, histograms, likelihoods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import bin_index, clip_to, finite
from ..functions.ranks import ranked

NOMINAL_HZ = 50.0
LOAD_INERTIA = 0.4
KEYS = ["co2l", "time_stamp", "split_number"]


def observables(c: DataFrame, limit: float = 1.0) -> DataFrame:
    """Rotational energy, rate of change of frequency and load-loss shares of each component.

    A component whose rate exceeds ``limit`` blacks out; else it sheds its deficit.
    """
    imb, load = F.col("power_imbalance"), F.col("load")
    c = c.withColumn("load_inertia", LOAD_INERTIA * load).withColumn("rot_energy", F.col("rot_energy_gen") + F.col("load_inertia"))
    c = c.withColumn("rocof_noLoadInertia", NOMINAL_HZ * imb / ((F.col("rot_energy_gen") + 1e-8) * 2)).withColumn("rocof", NOMINAL_HZ * imb / ((F.col("rot_energy") + 1e-8) * 2))
    c = c.withColumn("shedding", F.when(load != 0, F.abs(F.least(F.lit(0.0), imb)) / load * F.col("load_share")).otherwise(0.0))
    c = c.withColumn("blackout", F.when(F.abs("rocof") > limit, F.col("load_share")).otherwise(0.0))
    return c.withColumn("total", F.greatest("shedding", "blackout"))


def split_properties(c: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per split: lost-load shares, size, largest component, weights. A split has one trigger."""
    return c.groupBy(*keys).agg(
        F.min("init_failure_0").alias("init_failure_0"), F.min("init_failure_1").alias("init_failure_1"), F.min("trigger_weighting").alias("trigger_weighting"),
        F.sum("shedding").alias("lost_load_share_shedding"), F.sum("blackout").alias("lost_load_share_blackout"), F.sum("total").alias("lost_load_share_total"),
        F.count("*").alias("n_components"), F.max("load_share").alias("largest_component_load_share"), F.sum("load").alias("load"),
        F.min("snapshot_weighting").alias("snapshot_weighting"), (F.min("snapshot_weighting") * F.min("trigger_weighting")).cast("long").alias("total_weighting"),
    )


def at_thresholds(c: DataFrame, limits: list[float]) -> DataFrame:
    """Split properties under several limits at once: each component is taken once for each limit."""
    each = c.withColumn("limit_hz", F.explode(F.array(*map(F.lit, limits))))
    each = each.withColumn("blackout", F.when(F.abs("rocof") > F.col("limit_hz"), F.col("load_share")).otherwise(0.0)).withColumn("total", F.greatest("shedding", "blackout"))
    return split_properties(each, ["limit_hz", *KEYS])


def number_splits(s: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Consecutive numbers of splits within a scenario, in order of time and own number; ``keep`` writes the rows once."""
    r = ranked(s, "co2l", F.unix_timestamp(F.col("time_stamp").cast("timestamp")), ["split_number"], keep=keep)
    return r.withColumn("number", F.col("rank").cast("int")).drop("rank", "group_rows")


def histogram(df: DataFrame, x: Column, weight: Column, low: float, high: float, n: int, by: list[str] | None = None, clip: bool = True) -> DataFrame:
    """Weighted histogram by group; values outside are dropped, after clipping if asked for."""
    value = clip_to(x, low, high) if clip else x
    return df.withColumn("bin", bin_index(value, low, high, n)).where("bin is not null").groupBy(*(by or []), "bin").agg(F.sum(weight).alias("weight"))


def contingency_norm(pairs: DataFrame, snapshots: DataFrame, corridor: str | None = None) -> DataFrame:
    """The weight of all contingencies, whether they split or not, at all snapshots of each scenario: co2l, norm.

    ``pairs`` has line_0, line_1 and weight; ``corridor`` takes only those of one line
    ("same") or of two ("different"). ``snapshots`` has co2l, time_stamp and
    snapshot_weighting, repeated or not.
    """
    same = F.col("line_0") == F.col("line_1")
    kinds = {None: F.lit(True), "same": same, "different": ~same}
    all_pairs = pairs.where(kinds[corridor]).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("pw"))
    snap = snapshots.select("co2l", "time_stamp", "snapshot_weighting").distinct().groupBy("co2l").agg(F.sum("snapshot_weighting").alias("sw"))
    return snap.join(F.broadcast(all_pairs)).select("co2l", (F.col("pw") * F.col("sw")).alias("norm"))  # one row of pw


def risk_fraction(s: DataFrame, norm: DataFrame, n: int = 5) -> DataFrame:
    """Share of all weighted contingencies that lose this much load, by scenario and bin in percent."""
    h = histogram(s, F.col("lost_load_share_blackout") * 100, F.col("total_weighting"), 0.0, 100.0, n, ["co2l"])
    return h.join(norm, "co2l").select("co2l", "bin", "weight", (F.col("weight") / F.col("norm")).alias("fraction"))


def by_corridor(s: DataFrame) -> DataFrame:
    """Splits whose two triggers lie in one corridor against the others."""
    same = F.when(F.col("init_failure_0") == F.col("init_failure_1"), "same").otherwise("different")
    return s.groupBy("co2l", same.alias("corridor")).agg(F.sum("total_weighting").alias("weight"), F.count("*").alias("n"), F.sum(F.col("lost_load_share_blackout") * F.col("total_weighting")).alias("loss"))


def size_against_loss(s: DataFrame) -> DataFrame:
    """Lost load (ten bins) by size of the split, normalised over each size."""
    g = s.withColumn("bin", bin_index(clip_to(F.col("lost_load_share_blackout"), 0.0, 1.0), 0.0, 1.0, 10)).groupBy("n_components", "bin").agg(F.sum("total_weighting").alias("weight"))
    return g.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("n_components")))


def exceedance(c: DataFrame, limits: list[float]) -> DataFrame:
    """Share of finite rates beyond each limit, by scenario."""
    x = F.abs("rocof")
    return c.where(finite(F.col("rocof"))).groupBy("co2l").agg(*(F.avg((x > v).cast("double")).alias(f"above_{str(v).replace('.', '_')}") for v in limits))


def exceedance_curve(c: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Empirical exceedance 1 - i / n of sorted absolute rates; ties keep their rows; ``keep`` writes the rows once."""
    x = c.where(finite(F.col("rocof"))).select("co2l", "split_number", "component_number", F.abs("rocof").alias("x"))
    r = ranked(x, "co2l", F.col("x"), ["split_number", "component_number"], keep=keep)
    return r.select("co2l", "split_number", "component_number", (1 - F.col("rank") / F.col("group_rows")).alias("exceedance"))


def log_histogram(s: DataFrame, low: int = 0, high: int = 8, n: int = 16) -> DataFrame:
    """Absolute lost load in logarithmic bins from 10**low, as a density over all weights."""
    x = F.log10(F.col("lost_load_share_blackout") * F.col("load"))
    h = histogram(s.where("lost_load_share_blackout * load >= 1"), x, F.col("total_weighting"), float(low), float(high), n, ["co2l"], clip=False)
    k = (high - low) / n
    width = F.pow(F.lit(10.0), low + (F.col("bin") + 1) * k) - F.pow(F.lit(10.0), low + F.col("bin") * k)
    return h.withColumn("density", F.col("weight") / width / F.sum("weight").over(Window.partitionBy("co2l")))


def edge_likelihood(s: DataFrame, failed: DataFrame, edges: DataFrame, norm: DataFrame) -> DataFrame:
    """Weighted failures of each edge, by the weight of all simulations: secondary in cascades, primary as a trigger, and both.

    ``failed`` has split_number and edge, ``edges`` every edge of the grid; one that
    never fails has zeros. ``norm`` has the weights of all simulations by scenario. A
    trigger edge named twice counts twice as primary; total is secondary plus
    triggers that aren't in the cascade.
    """
    gone = failed.groupBy("split_number").agg(F.collect_set("edge").alias("gone"))  # at most the edges of the grid
    w = s.select("split_number", F.col("total_weighting").alias("w"), F.array("init_failure_0", "init_failure_1").alias("trig"))
    x = w.join(gone, "split_number", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    roles = F.concat(F.transform("gone", lambda e: F.struct(e.alias("edge"), F.lit(0).alias("first"), F.lit(1).alias("any"))), F.transform("trig", lambda e: F.struct(e.alias("edge"), F.lit(1).alias("first"), (~F.array_contains("gone", e)).cast("int").alias("any"))))
    e = x.select("w", F.explode(roles).alias("r"))
    sums = e.groupBy("r.edge").agg(F.sum(F.when(F.col("r.first") == 0, F.col("w"))).alias("secondary"), F.sum(F.when(F.col("r.first") == 1, F.col("w"))).alias("primary"), F.sum(F.col("w") * F.col("r.any")).alias("total"))
    total = norm.agg(F.sum("norm").alias("n"))
    out = edges.select("edge").join(sums, "edge", "left").fillna(0, ["secondary", "primary", "total"]).join(F.broadcast(total))  # one row of n
    return out.select("edge", *((F.col(c) / F.col("n")).alias(c) for c in ("secondary", "primary", "total")))


def edge_impact(s: DataFrame) -> DataFrame:
    """Lost load of the splits that an edge triggers, once for each split."""
    e = s.select("lost_load_share_blackout", "total_weighting", F.explode(F.array_distinct(F.array("init_failure_0", "init_failure_1"))).alias("edge"))
    return e.groupBy("edge").agg(F.sum("lost_load_share_blackout").alias("impact"), F.sum(F.col("lost_load_share_blackout") * F.col("total_weighting")).alias("weighted_impact"))


def top(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    """The n greatest rows with their rank; ties go to the smaller key."""
    return df.orderBy(F.desc(by), tie).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), tie)))


def crossing_share(ranked: DataFrame, flags: DataFrame, percents: list[float]) -> DataFrame:
    """Share of flagged edges among the top p percent by value: edge, value; edge, flag."""
    n = F.count("*").over(Window.partitionBy())
    r = ranked.join(flags, "edge").select("flag", F.row_number().over(Window.orderBy(F.desc("value"), "edge")).alias("r"), n.alias("n"))
    r = r.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("k", F.least(F.greatest(F.ceil(F.col("n") * F.col("percent") / 100), F.lit(1)), F.col("n")))
    return r.where("r <= k").groupBy("percent", "k").agg((F.sum(F.col("flag").cast("int")) / F.col("k")).alias("share"))


def largest_component(c: DataFrame) -> DataFrame:
    """The component of each split with the greatest load share, of equal ones the first."""
    best = F.max_by(F.struct("component_number", "load_share", "rocof"), F.struct(F.col("load_share"), -F.col("component_number")))
    return c.groupBy("split_number").agg(best.alias("b")).select("split_number", "b.*")


def loss_targets(s: DataFrame, severe: float = 0.8) -> DataFrame:
    """Total weighted loss, and number and loss of globally severe splits, by scenario."""
    x, w = F.least(F.col("lost_load_share_blackout"), F.lit(1.0)), F.col("total_weighting")
    return s.groupBy("co2l").agg(F.sum(x * w).alias("total_loss"), F.coalesce(F.sum(F.when(x > severe, w)), F.lit(0)).alias("n_severe"), F.coalesce(F.sum(F.when(x > severe, x * w)), F.lit(0.0)).alias("severe_loss"), F.count_if((x >= severe) & (x <= 1.0)).alias("rows_severe"))


def per_month(s: DataFrame) -> DataFrame:
    return s.groupBy("co2l", F.month("time_stamp").alias("month")).agg(F.count("*").alias("n"), F.sum("total_weighting").alias("weight"))


def calendar_profile(s: DataFrame) -> DataFrame:
    """Share of events by day of the week (Monday is 0) and day of the year counts."""
    g = s.groupBy(F.weekday("time_stamp").alias("day")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def consistent(a: DataFrame, b: DataFrame, digits: int = 9) -> DataFrame:
    """Rows of either side that the other lacks, after rounding: 0 for equal tables."""
    kinds = dict(a.dtypes)
    cols = [F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in a.columns]
    x, y = a.select(*cols), b.select(*a.columns).select(*cols)
    return x.exceptAll(y).agg(F.count("*").alias("only_first")).join(F.broadcast(y.exceptAll(x).agg(F.count("*").alias("only_second"))))


def largest_cases(batched: DataFrame) -> DataFrame:
    """The case with the most circuits out at each snapshot and pair of edges: time_stamp, edge_0, edge_1, circuits_0, circuits_1, splits.

    ``batched`` has these columns; cases are compared by circuits_0, then circuits_1, then splits.
    """
    keys = ["time_stamp", "edge_0", "edge_1"]
    return batched.groupBy(*keys).agg(F.max(F.struct("circuits_0", "circuits_1", "splits")).alias("x")).select(*keys, "x.*")


def case_counts(old: DataFrame, batched: DataFrame) -> DataFrame:
    """Splits of an old study and of one in batches, by snapshot of either: time_stamp, n_old, n_batched, difference, unsplit.

    ``old`` has a row with time_stamp for each split, ``batched`` is that of ``largest_cases``;
    unsplit counts kept cases that don't split, which a study of splits should not hold.
    """
    a = old.groupBy("time_stamp").agg(F.count("*").alias("n_old"))
    b = largest_cases(batched).groupBy("time_stamp").agg(F.count_if("splits").alias("n_batched"), F.count_if(~F.col("splits")).alias("unsplit"))
    x = a.join(b, "time_stamp", "full").fillna(0, ["n_old", "n_batched", "unsplit"])
    return x.select("time_stamp", "n_old", "n_batched", (F.col("n_old") - F.col("n_batched")).alias("difference"), "unsplit")


def trigger_edges(s: DataFrame) -> DataFrame:
    """Edges that any of two triggers names, once for each scenario: co2l, edge."""
    return s.select("co2l", F.explode(F.array("init_failure_0", "init_failure_1")).alias("edge")).where("edge is not null").distinct()


def snapshot_weights(observed: DataFrame, listed: DataFrame) -> DataFrame:
    """Hours that the snapshots of each scenario stand for, and how they are known: co2l, weight, missing, reason.

    ``observed`` has the weights of snapshots with a split (co2l, time_stamp, snapshot_weighting),
    ``listed`` the number of all snapshots of a scenario (co2l, n). Nothing missing: the sum
    ("complete"); some missing, but all weights equal: that weight for all ("uniform");
    some missing and weights differ: the sum, too small ("observed"); no list: the sum ("unlisted").
    """
    each = observed.select("co2l", "time_stamp", "snapshot_weighting").distinct()
    sums = each.groupBy("co2l").agg(F.sum("snapshot_weighting").cast("double").alias("total"), F.count("*").alias("seen"), F.min("snapshot_weighting").alias("least"), F.max("snapshot_weighting").alias("most"))
    x = sums.join(listed.select("co2l", "n"), "co2l", "left").withColumn("missing", F.when(F.col("n").isNotNull(), F.greatest(F.col("n") - F.col("seen"), F.lit(0))))
    reason = F.when(F.col("n").isNull(), "unlisted").when(F.col("missing") == 0, "complete").when(F.col("least") == F.col("most"), "uniform").otherwise("observed")
    return x.select("co2l", F.when(reason == "uniform", (F.col("least") * F.col("n")).cast("double")).otherwise(F.col("total")).alias("weight"), "missing", reason.alias("reason"))
