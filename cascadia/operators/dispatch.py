"""Dispatch analytics: generation, load, balances, emissions, inertia, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import bin_index

SEASONS = ("winter", "winter", "spring", "spring", "spring", "summer", "summer", "summer", "autumn", "autumn", "autumn", "winter")


def season(time: str = "snapshot") -> Column:
    return F.element_at(F.array(*map(F.lit, SEASONS)), F.month(time))


def families(carrier: Column) -> Column:
    """Carrier families by parts of the name; what belongs to none keeps its name."""
    c = F.lower(carrier)
    return F.when(c.contains("click") | c.contains("view"), "browse").when(c == "purchase", "trade").when(c == "signup", "account").otherwise(carrier)


def pivoted(g: DataFrame, carriers: list[str]) -> DataFrame:
    """Weighted signed energy of each carrier by month, as columns."""
    return g.groupBy(F.month("snapshot").alias("month")).pivot("carrier", carriers).agg(F.sum(F.col("p") * F.col("w") * F.col("sign"))).fillna(0.0)


def significant(g: DataFrame, share: float = 0.01) -> DataFrame:
    """Carriers whose share of any day's energy exceeds ``share``, with their greatest share."""
    d = g.groupBy(F.to_date("snapshot").alias("day"), "carrier").agg(F.sum("p").alias("p"))
    d = d.withColumn("share", F.col("p") / F.sum("p").over(Window.partitionBy("day")))
    return d.groupBy("carrier").agg(F.max("share").alias("share")).where(F.col("share") > share)


def capacity(g: DataFrame) -> DataFrame:
    """Signed nominal power by carrier family, from one row per bus and carrier."""
    unit = g.select("bus", "carrier", "p_nom", "sign").distinct()
    return unit.groupBy(families(F.col("carrier")).alias("family")).agg(F.sum(F.col("p_nom") * F.col("sign")).alias("capacity"), F.count("*").alias("units"))


def by_country(g: DataFrame, nation: DataFrame) -> DataFrame:
    """Mean generation of each country: the weighted mean of each unit, summed; unknown buses are UNK."""
    unit = g.groupBy("bus", "carrier").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"))
    names = nation.select(F.col("n_nationkey").alias("bus"), F.upper(F.substring("n_name", 1, 2)).alias("country"))
    return unit.join(names, "bus", "left").groupBy(F.coalesce("country", F.lit("UNK")).alias("country")).agg(F.sum("p").alias("p"))


def nodal_balance(g: DataFrame, loads: DataFrame, links: DataFrame) -> DataFrame:
    """Consumption less supply of each bus and month: signed streams in one union, consumption positive."""
    month = F.month("snapshot")
    streams = g.select(month.alias("month"), "bus", (-F.col("p") * F.col("sign")).alias("x"))
    streams = streams.unionByName(loads.select(month.alias("month"), "bus", F.col("p").alias("x")))
    at0 = links.select(F.lit(1).alias("month"), F.col("bus0").alias("bus"), F.col("p0").alias("x"))
    at1 = links.select(F.lit(1).alias("month"), F.col("bus1").alias("bus"), F.col("p1").alias("x"))
    return streams.unionByName(at0).unionByName(at1).groupBy("month", "bus").agg(F.sum("x").alias("balance"))


def nodal_mean(balance: DataFrame) -> DataFrame:
    """Mean and mean weighted consumption of each bus (the weighted one isn't divided by the weights)."""
    w = F.when(F.col("month") <= 2, 1.0).otherwise(3.0)
    return balance.groupBy("bus").agg(F.avg("balance").alias("mean"), F.avg(F.col("balance") * w).alias("mean_weighted"))


def dipole(injection: DataFrame) -> DataFrame:
    """Dipole of each snapshot's injections about the mean position (nodes on a 5 x 5 lattice), and their sum."""
    x, y = F.col("node_idx") % 5, F.floor(F.col("node_idx") / 5)
    return injection.groupBy("snapshot").agg(F.sum((x - 2.0) * F.col("p0")).alias("dipole_x"), F.sum((y - 2.0) * F.col("p0")).alias("dipole_y"), F.sum("p0").alias("mismatch"))


def monthly_dipole(d: DataFrame) -> DataFrame:
    """Mean dipole by month of the year, later years weighing more."""
    w = F.year("snapshot") - 1994
    return d.groupBy(F.month("snapshot").alias("month")).agg((F.sum(F.col("dipole_x") * w) / F.sum(w)).alias("dipole_x"), (F.sum(F.col("dipole_y") * w) / F.sum(w)).alias("dipole_y"))


def emissions(g: DataFrame, factors: dict[str, float], efficiency: float = 0.4) -> DataFrame:
    """Emissions of each day and what they are of a limit; carriers without a factor emit nothing."""
    f = F.coalesce(*[F.when(F.col("carrier") == k, F.lit(v)) for k, v in factors.items()], F.lit(0.0))
    return g.groupBy(F.to_date("snapshot").alias("day")).agg((F.sum(F.col("p") * F.col("w") / efficiency * f)).alias("emissions")).withColumn("level", F.col("emissions") / (1e6 + 1e-10))


def costs(g: DataFrame, marginal: dict[str, float], capital: float = 90.0) -> DataFrame:
    """Operating cost (energy not weighted by snapshots) and capital cost by carrier."""
    m = F.coalesce(*[F.when(F.col("carrier") == k, F.lit(v)) for k, v in marginal.items()], F.lit(0.0))
    op = g.groupBy("carrier").agg(F.sum(F.col("p") * m).alias("opex"))
    cap = g.select("bus", "carrier", "p_nom").distinct().groupBy("carrier").agg((F.sum("p_nom") * capital).alias("capex"))
    return op.join(cap, "carrier", "full").fillna(0.0)


def special_carriers(g: DataFrame, carriers: list[str]) -> DataFrame:
    """Energy and active snapshots of some carriers; those that are absent have zeros."""
    names = F.explode(F.array(*map(F.lit, carriers)))
    want = g.sparkSession.range(1).select(names.alias("carrier"))
    snap = g.groupBy("carrier", "snapshot").agg(F.sum(F.col("p") * F.col("w")).alias("e"))
    total = g.agg(F.sum(F.col("p") * F.col("w")).alias("all_e"), F.count_distinct("snapshot").alias("all_n"))
    per = snap.groupBy("carrier").agg(F.sum("e").alias("energy"), F.count_if(F.abs("e") > 1e-6).alias("snapshots"))
    out = want.join(per, "carrier", "left").fillna(0).join(F.broadcast(total))
    return out.select("carrier", "energy", (F.col("energy") / F.col("all_e")).alias("energy_share"), "snapshots", (F.col("snapshots") / F.col("all_n")).alias("snapshot_share"))


def inertia(g: DataFrame, constants: dict[str, float]) -> DataFrame:
    """Rotational energy by snapshot and carrier: units above 5 % of their nominal power run at it."""
    h = F.coalesce(*[F.when(F.col("carrier") == k, F.lit(v)) for k, v in constants.items()], F.lit(0.0))
    e = F.when(F.col("p") > 0.05 * F.col("p_nom"), h * F.col("p_nom")).otherwise(0.0)
    return g.groupBy("snapshot", "carrier").agg(F.sum(e).alias("energy"))


def mean_inertia(per: DataFrame) -> DataFrame:
    """Mean energy by carrier over all snapshots, also those that lack it."""
    n = per.agg(F.count_distinct("snapshot").alias("n"))
    return per.groupBy("carrier").agg(F.sum("energy").alias("e")).join(F.broadcast(n)).select("carrier", (F.col("e") / F.col("n")).alias("mean_energy"))


def extreme_inertia(per: DataFrame) -> DataFrame:
    """Least and greatest total energy, with their earliest snapshots."""
    s = per.groupBy("snapshot").agg(F.round(F.sum("energy"), 4).alias("energy"))
    return s.agg(F.min("energy").alias("low"), F.min_by("snapshot", F.struct("energy", "snapshot")).alias("low_at"), F.max("energy").alias("high"), F.min_by("snapshot", F.struct(-F.col("energy"), F.col("snapshot"))).alias("high_at"))


def flow_distance(links: DataFrame) -> DataFrame:
    """Sum of flow times distance by source, and its ratio to the flow."""
    d = F.sqrt(F.pow(F.col("bus0") % 5 - F.col("bus1") % 5, F.lit(2)) + F.pow(F.floor(F.col("bus0") / 5) - F.floor(F.col("bus1") / 5), F.lit(2)))
    return links.groupBy("bus0").agg(F.sum(F.abs("p0") * d).alias("flow_distance"), (F.sum(F.abs("p0") * d) / F.sum(F.abs("p0"))).alias("mean_distance"))


def flow_distances(flows: DataFrame, transmitted: DataFrame | None = None, unit: float = 1e6) -> DataFrame:
    """Sum of absolute flow times length at each snapshot of a scenario: co2l, snapshot, flow_distance.

    ``flows`` has co2l, snapshot, p0 and length of each line. It is in ``unit``, or, with the power that
    is ``transmitted`` (co2l, snapshot, p), the mean distance of that power; without any power it is null.
    """
    keys = ["co2l", "snapshot"]
    d = flows.groupBy(*keys).agg(F.sum(F.abs("p0") * F.col("length")).alias("d"))
    if transmitted is None:
        return d.select(*keys, (F.col("d") / unit).alias("flow_distance"))
    return d.join(transmitted, keys, "left").select(*keys, F.try_divide("d", "p").alias("flow_distance"))


def transmitted_power(generation: DataFrame, storage: DataFrame) -> DataFrame:
    """Generation (co2l, snapshot, p, sign) and what storage units (co2l, snapshot, p) give, not what they take: co2l, snapshot, p."""
    both = generation.select("co2l", "snapshot", (F.col("p") * F.col("sign")).alias("p")).unionByName(storage.where("p > 0").select("co2l", "snapshot", "p"))
    return both.groupBy("co2l", "snapshot").agg(F.sum("p").alias("p"))


def distance_histogram(series: DataFrame, weights: DataFrame, n: int = 39) -> DataFrame:
    """Share of each scenario's weighted snapshots in n equal bins between the extremes of all scenarios: co2l, bin, share.

    ``series`` is that of ``flow_distances``, ``weights`` has co2l, snapshot and w, whose sum over a scenario is its whole. Empty bins have no row.
    """
    ends = series.agg(F.min("flow_distance").alias("low"), F.max("flow_distance").alias("high"))
    whole = weights.groupBy("co2l").agg(F.sum("w").alias("whole"))
    x = series.join(weights, ["co2l", "snapshot"]).join(F.broadcast(ends))  # one row of ends
    b = x.withColumn("bin", bin_index(F.col("flow_distance"), F.col("low"), F.col("high"), n)).where("bin is not null").groupBy("co2l", "bin").agg(F.sum("w").alias("w"))
    return b.join(whole, "co2l").select("co2l", "bin", (F.col("w") / F.col("whole")).alias("share"))


def on_calendar(df: DataFrame, time: str = "snapshot", months: list[int] | None = None, seasons: list[str] | None = None, weekdays: list[int] | None = None, hours: list[int] | None = None) -> DataFrame:
    """Rows at the given months, seasons, days of the week (Monday is 0) and hours; what isn't given isn't asked."""
    asked = ((F.month(time), months), (season(time), seasons), (F.weekday(time), weekdays), (F.hour(time), hours))
    for part, values in asked:
        df = df if values is None else df.where(part.isin(values))
    return df


def mean_nodal_load(loads: DataFrame) -> DataFrame:
    """Mean load of each bus, months weighed by their number."""
    w = F.month("snapshot")
    return loads.groupBy("bus").agg((F.sum(F.col("p") * w) / F.sum(w)).alias("load"))


def ramps(g: DataFrame) -> DataFrame:
    """Change of total power to the snapshot before, in thousands."""
    s = g.groupBy("snapshot").agg(F.sum("p").alias("p"))
    return s.withColumn("ramp", (F.col("p") - F.lag("p").over(Window.orderBy("snapshot"))) / 1000).where("ramp is not null").select("snapshot", "ramp")


def rolling_mean(g: DataFrame, width: int) -> DataFrame:
    """Centred rolling mean of each carrier's power; an even window reaches one further back."""
    s = g.groupBy("carrier", "snapshot").agg(F.sum("p").alias("p"))
    w = Window.partitionBy("carrier").orderBy("snapshot").rowsBetween(-(width // 2), (width + 1) // 2 - 1)
    return s.select("carrier", "snapshot", F.avg("p").over(w).alias("mean"))


def seasonal_profile(g: DataFrame) -> DataFrame:
    """Mean power by season, hour and carrier of the snapshots' sums."""
    s = g.groupBy("snapshot", "carrier").agg(F.sum(F.col("p") * F.col("sign")).alias("p"))
    return s.groupBy(season().alias("season"), F.hour("snapshot").alias("hour"), "carrier").agg(F.avg("p").alias("p"))


def unit_profile(g: DataFrame, carrier: str) -> DataFrame:
    """Mean power of a carrier by month and hour."""
    s = g.where(F.col("carrier") == carrier).groupBy("snapshot").agg(F.sum("p").alias("p"))
    return s.groupBy(F.month("snapshot").alias("month"), F.hour("snapshot").alias("hour")).agg(F.avg("p").alias("p"))


def low_quantile(g: DataFrame, q: float = 0.1) -> DataFrame:
    """Snapshots whose total is at or below the (linearly interpolated) quantile."""
    s = g.groupBy("snapshot").agg(F.round(F.sum("p"), 6).alias("p"))
    cut = s.agg(F.percentile("p", q).alias("cut"))
    return s.join(F.broadcast(cut), F.col("p") <= F.col("cut")).select("snapshot", "p")


def loading_summary(x: DataFrame, limit: float = 1.0) -> DataFrame:
    """Mean and greatest loadings of each line, overloads, and the greatest difference."""
    return x.groupBy("line").agg(F.avg("dc").alias("mean_dc"), F.max("dc").alias("max_dc"), F.avg("ac").alias("mean_ac"), F.max("ac").alias("max_ac"), F.count_if(F.col("ac") > limit).alias("n_over"), F.max(F.abs(F.col("ac") - F.col("dc"))).alias("max_diff"))


def loading_spread(x: DataFrame, limit: float = 0.5) -> DataFrame:
    """Spread of AC to DC ratios over seeds, for lines and snapshots above a DC loading."""
    r = F.col("ac") / F.col("dc")
    return x.where(F.col("dc") > limit).groupBy("snapshot", "line").agg((F.max(r) - F.min(r)).alias("spread"), F.avg((F.col("ac") - F.col("dc")) / F.col("dc")).alias("relative"))


def loading_deviation(x: DataFrame) -> DataFrame:
    """Median, upper decile (interpolated) and population deviation of each line's loading."""
    return x.groupBy("line").agg(F.median("dc").alias("median"), F.percentile("dc", 0.9).alias("decile"), F.stddev_pop("dc").alias("deviation"))


def ac_against_dc(ac: DataFrame, dc: DataFrame, converged: DataFrame) -> DataFrame:
    """AC and DC loadings of the lines that both studies have, at snapshots and seeds that converged: snapshot, seed, line, ac, dc.

    ``ac`` and ``dc`` have snapshot, seed, line and a value of that name, ``converged`` the
    snapshots and seeds with a flag; rows without a value are left out.
    """
    keys = ["snapshot", "seed", "line"]
    both = ac.where("ac is not null").join(dc.where("dc is not null"), keys)
    return both.join(converged.where("converged").select("snapshot", "seed").distinct(), ["snapshot", "seed"], "left_semi").select(*keys, "ac", "dc")


def at_splits(loadings: DataFrame, splits: DataFrame, threshold: float | None = None) -> DataFrame:
    """Loadings at the snapshots with a split, or with one that loses more than ``threshold``; snapshots of splits that have none are refused."""
    hit = splits if threshold is None else splits.where(F.col("lost_load_share_blackout") > threshold)
    at = hit.select(F.col("time_stamp").alias("snapshot")).distinct()
    lost = at.join(loadings.select("snapshot").distinct(), "snapshot", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no loadings at {lost[0][0]}, a snapshot with a split")
    return loadings.join(at, "snapshot", "left_semi")


def snapped_range(times: DataFrame, start: str, stop: str) -> DataFrame:
    """Rows between the last time at or before ``start`` (else the first) and the first at or after ``stop`` (else the last)."""
    t = F.col("snapshot")
    ends = times.agg(F.coalesce(F.max(F.when(t <= F.lit(start).cast("timestamp_ntz"), t)), F.min(t)).alias("lo"), F.coalesce(F.min(F.when(t >= F.lit(stop).cast("timestamp_ntz"), t)), F.max(t)).alias("hi"))
    return times.join(F.broadcast(ends), t.between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def nearest_hour(hours: DataFrame, available: list[int]) -> DataFrame:
    """The nearest available hour on the clock, of equal ones the smaller."""
    d = lambda h: F.abs(F.col("hour") - h)
    options = F.array(*[F.struct(F.least(d(h), 24 - d(h)).alias("d"), F.lit(h).alias("h")) for h in available])
    return hours.withColumn("nearest", F.array_min(options)["h"])


#: Times of day that a drawn day contributes, and the hours asked for.
TIMES = {"morning": 7, "noon": 12, "evening": 18, "night": 0}


def drawn_snapshots(times: DataFrame, realizations: int, weekdays: int = 2, sundays: int = 1, hours: dict[str, int] | None = None, seed: int = 0) -> DataFrame:
    """Reproducible draws of snapshots: realization, season, day_type, time_label, snapshot.

    Each realization draws ``weekdays`` Mondays to Fridays and ``sundays`` Sundays of each season, as many as there
    are, by a digest of seed, realization and day, so that a draw is the same on every run and
    for every scenario. A drawn day contributes its snapshots at the hours nearest to those
    asked for among all hours of the table (on the clock; of equal ones the smaller), where it has them.
    """
    spark = times.sparkSession
    stamps = times.select("snapshot").distinct()
    available = sorted(r[0] for r in stamps.select(F.hour("snapshot")).distinct().collect())  # 24 at most
    asked = spark.createDataFrame(list((hours or TIMES).items()), "time_label string, hour int")
    snapped = nearest_hour(asked, available) if available else asked.withColumn("nearest", F.col("hour"))
    day = stamps.select(F.to_date("snapshot").alias("day"), season().alias("season")).distinct()
    day = day.withColumn("day_type", F.when(F.weekday("day") == 6, "sunday").when(F.weekday("day") < 5, "weekday")).where("day_type is not null")
    day = day.withColumn("realization", F.explode(F.sequence(F.lit(0), F.lit(realizations - 1))))
    digest = F.md5(F.concat_ws("|", (F.col("realization") + seed).cast("string"), F.date_format("day", "yyyy-MM-dd")))
    r = F.row_number().over(Window.partitionBy("realization", "season", "day_type").orderBy(digest, "day"))
    most = F.when(F.col("day_type") == "sunday", sundays).otherwise(weekdays)
    pick = day.withColumn("r", r).where(F.col("r") <= most).join(F.broadcast(snapped))
    at = stamps.select("snapshot", F.to_date("snapshot").alias("day"), F.hour("snapshot").alias("nearest"))
    return at.where((F.minute("snapshot") == 0) & (F.second("snapshot") == 0)).join(F.broadcast(pick), ["day", "nearest"]).select("realization", "season", "day_type", "time_label", "snapshot")


def stratified(times: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` weekdays and ``n`` Sundays of each season by hash, all their snapshots."""
    day = times.select(F.to_date("snapshot").alias("day"), season().alias("season")).distinct()
    day = day.withColumn("kind", F.when(F.weekday("day") == 6, "sunday").when(F.weekday("day") < 5, "weekday")).where("kind is not null")
    pick = day.withColumn("r", F.row_number().over(Window.partitionBy("season", "kind").orderBy(F.xxhash64("day", F.lit(seed)), "day"))).where(F.col("r") <= n)
    return times.join(pick.select("day", "season", "kind"), F.to_date(times.snapshot) == F.col("day")).drop("day")
