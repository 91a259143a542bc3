"""Units, capacities and reinforcements of a grid, and rankings of clusterings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean radius of the earth in km.
RADIUS = 6371.0088


def unit_rollup(members: DataFrame, generators: DataFrame, storage: DataFrame, loads: DataFrame, links: DataFrame, inertia: dict[str, float]) -> DataFrame:
    """Generation, storage, load, exchange and inertia of components from their units.

    ``members`` (split_number, component_number, node); ``generators`` and
    ``storage`` (unit, bus, carrier, p, p_nom, p_max_pu, sign), ``loads`` (bus, p),
    ``links`` (bus, p, what leaves by HVDC). A unit is online if it gives more than a
    twentieth of what it could; online units add their constant times available
    power. The load share is that of all members' load in the split.
    """
    h = F.coalesce(*[F.when(F.col("carrier") == k, F.lit(v)) for k, v in inertia.items()], F.lit(0.0))
    able = F.col("p_max_pu") * F.col("p_nom")
    energy = F.when(F.col("p") > 0.05 * able, h * able).otherwise(0.0)
    # Units are summed by bus before they meet the members.
    gen = generators.groupBy("bus").agg(F.sum(F.col("p") * F.col("sign")).alias("generation"), F.sum(energy).alias("gen_energy"))
    sto = storage.groupBy("bus").agg(F.sum(F.col("p") * F.col("sign")).alias("storage"), F.sum(energy).alias("sto_energy"))
    load = loads.groupBy("bus").agg(F.sum("p").alias("load"))
    out = links.groupBy("bus").agg(F.sum("p").alias("hvdc"))
    x = members.withColumnRenamed("node", "bus")
    for part in (gen, sto, load, out):
        x = x.join(part, "bus", "left")
    x = x.fillna(0.0, ["generation", "gen_energy", "storage", "sto_energy", "load", "hvdc"])
    c = x.groupBy("split_number", "component_number").agg(F.count("*").alias("n_nodes"), *(F.sum(k).alias(k) for k in ("generation", "storage", "load", "hvdc")), F.sum(F.col("gen_energy") + F.col("sto_energy")).alias("rot_energy_gen"))
    c = c.withColumn("power_imbalance", F.col("generation") + F.col("storage") - F.col("load") - F.col("hvdc"))
    return c.withColumn("load_share", F.col("load") / F.sum("load").over(Window.partitionBy("split_number")))


def storage_energy(units: DataFrame) -> DataFrame:
    """Energy capacity of storage by bus and carrier: hours times power times efficiency."""
    return units.groupBy("bus", "carrier").agg(F.sum(F.col("max_hours") * F.col("p_nom") * F.col("efficiency")).alias("energy"))


def capacity_by_bus(units: DataFrame, without: list[str]) -> DataFrame:
    """Capacity by bus and carrier with the carrier's total, carriers in ``without`` left out."""
    g = units.where(~F.col("carrier").isin(without)).groupBy("bus", "carrier").agg(F.sum("p_nom").alias("capacity"))
    return g.withColumn("carrier_total", F.sum("capacity").over(Window.partitionBy("carrier")))


def order_faults(edges: DataFrame) -> DataFrame:
    """How many edges have their ends or numbers out of order: u beyond v, or a number that isn't the rank of (u, v)."""
    # One row for each edge of one grid.
    r = edges.withColumn("rank", F.row_number().over(Window.orderBy("u", "v")) - 1)
    return r.agg(F.count_if(F.col("u") > F.col("v")).alias("turned"), F.count_if(F.col("rank") != F.col("edge_idx")).alias("misplaced"), F.count("*").alias("n"))


def rescaled(lines: DataFrame) -> DataFrame:
    """Lines after an optimised extension: reactance by the factor of s_nom_opt, circuits from currents and voltage.

    ``lines`` has line, s_nom, s_nom_opt, x_pu_eff, i_nom and v_nom.
    """
    f = F.col("s_nom_opt") / F.col("s_nom")
    return lines.select("line", F.col("s_nom_opt").alias("s_nom"), (F.col("x_pu_eff") / f).alias("x_pu_eff"), (F.col("s_nom_opt") / (F.sqrt(F.lit(3.0)) * F.col("i_nom") * F.col("v_nom"))).alias("num_parallel"))


def extended(edges: DataFrame, ranking: DataFrame, most: int, more: float = 1.0) -> DataFrame:
    """``more`` circuits for the ``most`` edges of the highest ``value`` (ties to the smaller edge), limits and weights in proportion."""
    top = ranking.orderBy(F.desc("value"), "edge").limit(most).select(F.col("edge").alias("edge_idx"), F.lit(True).alias("chosen"))
    x = edges.join(top, "edge_idx", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    par = F.col("num_parallel") + F.when(F.col("chosen"), more).otherwise(0.0)
    f = par / F.col("num_parallel")
    return x.select("edge_idx", "u", "v", (F.col("weight") * f).alias("weight"), (F.col("s_nom") * f).alias("s_nom"), par.alias("num_parallel"), "chosen")


def partition(weights: DataFrame, sizes: tuple[float, float, float], most: int = 12) -> DataFrame:
    """The first (c0, c1, c2), in ascending order, whose circuits of three sizes add up to ``weight`` within 1e-6: id, weight, c.

    c is null if there is none with at most ``most`` of each.
    """
    count = F.sequence(F.lit(0), F.lit(most))
    tries = F.flatten(F.transform(count, lambda a: F.flatten(F.transform(count, lambda b: F.transform(count, lambda c: F.array(a, b, c))))))
    adds = F.filter(tries, lambda t: F.abs(t[0] * sizes[0] + t[1] * sizes[1] + t[2] * sizes[2] - F.col("weight")) <= 1e-6)
    distinct = weights.select("weight").distinct().withColumn("c", F.when(F.size(adds) > 0, adds[0]))
    return weights.join(distinct, "weight").select("id", "weight", "c")


def largest_circuit(counts: DataFrame) -> DataFrame:
    """The largest circuit of each line, from its circuits by size."""
    return counts.groupBy("line").agg(F.max(F.round("size", 5)).alias("largest"))


def outage_parts(lines: DataFrame, over: float = 1.01) -> DataFrame:
    """Each line as the circuit that may fail and what remains, limits in proportion and ``over`` times as large."""
    one = F.least(F.col("largest"), F.col("num_parallel"))
    parts = F.array(F.struct(F.concat("name", F.lit("_outage")).alias("name"), one.alias("num_parallel")), F.struct(F.col("name"), (F.col("num_parallel") - one).alias("num_parallel")))
    x = lines.select(F.col("num_parallel").alias("whole"), F.col("s_nom").alias("limit"), F.explode(parts).alias("p"))
    return x.where("p.num_parallel > 1e-8").select("p.name", "p.num_parallel", (F.col("limit") * F.col("p.num_parallel") / F.col("whole") * over).alias("s_nom"))


def artificial_units(buses: DataFrame) -> DataFrame:
    """A unit that may add, and one that may take, at every bus: name, bus, carrier, sign."""
    kinds = F.array(F.struct(F.lit("load").alias("carrier"), F.lit(1e-3).alias("sign")), F.struct(F.lit("art_load").alias("carrier"), F.lit(-1e-3).alias("sign")))
    return buses.select("bus", F.explode(kinds).alias("k")).select(F.concat_ws(" ", F.col("bus").cast("string"), "k.carrier").alias("name"), "bus", "k.carrier", "k.sign")


def crossing_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges with the group of either end and whether they cross; ``groups`` has node and group."""
    x = edges.select("edge_idx", "u", "v")
    for end in "uv":
        x = x.join(groups.select(F.col("node").alias(end), F.col("group").alias(f"group_{end}")), end)
    return x.select("edge_idx", "group_u", "group_v", (F.col("group_u") != F.col("group_v")).alias("crosses"))


def splits_with_edge(failed: DataFrame, sizes: DataFrame, edge: int) -> DataFrame:
    """Splits in which an edge fails, with the sizes of their components in descending order."""
    hit = failed.where(F.col("edge") == edge).select("split_number").distinct()
    return sizes.join(hit, "split_number", "left_semi").groupBy("split_number").agg(F.sort_array(F.collect_list("n_nodes"), False).alias("sizes"))


def geodesic(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Great-circle distance in km of points in degrees."""
    a, b = F.radians(lat0), F.radians(lat1)
    s = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def inhomogeneity(dipoles: DataFrame, lat: float, lon: float, scale: float = 1e6) -> DataFrame:
    """Length in km of each snapshot's dipole, laid from the mean position of the buses: snapshot, km."""
    d = geodesic(F.lit(lat), F.lit(lon), lat + F.col("dipole_y") / scale, lon + F.col("dipole_x") / scale)
    return dipoles.select("snapshot", d.alias("km"))


def inhomogeneity_at(dipoles: DataFrame, buses: DataFrame, scale: float = 1e6) -> DataFrame:
    """``inhomogeneity`` from the mean of the positions of ``buses`` (lat, lon); a dipole that leads off the globe is refused."""
    at = buses.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    lat, lon = (F.col(c) + F.col(f"dipole_{k}") / scale for c, k in (("lat", "y"), ("lon", "x")))
    valid = F.assert_true((F.abs(lat) <= 90) & (F.abs(lon) <= 360), "a dipole leads to no valid position")
    return dipoles.join(F.broadcast(at)).select("snapshot", F.when(valid.isNull(), geodesic(F.col("lat"), F.col("lon"), lat, lon)).alias("km"))  # one row of at


def failed_edge_vector(failed: DataFrame, n: int) -> DataFrame:
    """Whether each of n edges fails in each split: split_number, v."""
    s = failed.groupBy("split_number").agg(F.collect_set("edge").alias("e"))
    return s.select("split_number", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains("e", i)).alias("v"))


def component_vectors(x: DataFrame, key: str, v: str) -> DataFrame:
    """A 0/1 vector for each value of a vector but its most frequent one (of equal ones the smallest): key, value, v."""
    values = x.select(key, v, F.explode(v).alias("value")).groupBy(key, "value").agg(F.count("*").alias("n"), F.first(v).alias("v"))
    main = values.groupBy(key).agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("main"))
    return values.join(main, key).where("value <> main").select(key, "value", F.transform("v", lambda e: (e == F.col("value")).cast("int")).alias("v"))


def load_vectors(c: DataFrame, n: int, level: float, levels: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6)) -> DataFrame:
    """Load at each node of the splits of one scenario, whether it has any, and the split's weight: split_number, v, mask, weight."""
    if level not in levels:
        raise ValueError(f"no scenario of {level}")
    per = c.where(F.abs(F.col("co2l") - level) < 1e-9).groupBy("split_number", "node_idx").agg(F.sum("load").alias("x"), F.max("trigger_weighting").alias("tw"), F.max("snapshot_weighting").alias("sw"))
    m = per.groupBy("split_number").agg(F.map_from_entries(F.collect_list(F.struct("node_idx", "x"))).alias("m"), F.max(F.col("tw") * F.col("sw")).cast("long").alias("weight"))
    v = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return m.select("split_number", v.alias("v"), F.transform(v, lambda e: e > 0).alias("mask"), "weight")


def edge_centroids(failed: DataFrame, clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Weighted share of each cluster's splits in which an edge fails: label, edge, share; ``clusters`` has split_number, label, weight."""
    whole = clusters.groupBy("label").agg(F.sum("weight").alias("whole"))
    hit = failed.distinct().join(clusters, "split_number").groupBy("label", "edge").agg(F.sum("weight").alias("hit"))
    every = whole.withColumn("edge", F.explode(F.lit(edges.select(F.collect_set("edge")).first()[0])))  # the edges of one grid
    return every.join(hit, ["label", "edge"], "left").select("label", "edge", (F.coalesce("hit", F.lit(0)) / F.col("whole")).alias("share"))


def cluster_histogram(s: DataFrame, norm: DataFrame, bin_: Column) -> DataFrame:
    """Share of all contingencies by cluster, scenario and bin of lost load: label, co2l, bin, fraction."""
    h = s.groupBy("label", "co2l", bin_.alias("bin")).agg(F.sum("total_weighting").alias("weight"))
    return h.join(norm, "co2l").select("label", "co2l", "bin", (F.col("weight") / F.col("norm")).alias("fraction"))


def result_index(scores: DataFrame, algorithm: Column, params: Column) -> DataFrame:
    """A catalog of clusterings: algorithm, params, n_clusters, n_samples and the mean score of their rows, the best marked."""
    g = scores.groupBy(algorithm.alias("algorithm"), params.alias("params")).agg(F.count_distinct("label").alias("n_clusters"), F.count("*").alias("n_samples"), F.round(F.avg("score"), 9).alias("score"))
    return g.withColumn("best", F.row_number().over(Window.partitionBy("algorithm").orderBy(F.desc("score"), "params")) == 1)


def best_results(index: DataFrame, by: str, most: int | None = None, within: float | None = None) -> DataFrame:
    """The best of each algorithm: the first ``most``, or all whose value is at least 1 - ``within`` of the best one."""
    w = Window.partitionBy("algorithm")
    if most is not None:
        return index.withColumn("rank", F.row_number().over(w.orderBy(F.desc(by), "params"))).where(F.col("rank") <= most)
    r = index.withColumn("rank", F.row_number().over(w.orderBy(F.desc(by), "params"))).withColumn("_best", F.max(by).over(w))
    return r.where(F.col(by) >= F.col("_best") * (1 - within)).drop("_best")


def placement_progress(log: DataFrame, total: float | Column, n_components: int | Column) -> DataFrame:
    """Share mitigated and gain by component after each step of a plan: step, mitigated, gain_by_component."""
    run = F.sum("gain").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))  # one row for each step of a plan
    return log.select("step", (run / total).alias("mitigated"), (run / n_components).alias("gain_by_component"))


def severity_weights(c: DataFrame, s: DataFrame, severe: float = 0.8) -> DataFrame:
    """Components with mitigation_weighting: 1 for those of splits that lose more than ``severe``, else 0."""
    hit = s.where(F.col("lost_load_share_blackout") > severe).select("split_number", F.lit(1).alias("hit"))
    return c.join(hit, "split_number", "left").withColumn("mitigation_weighting", F.coalesce("hit", F.lit(0))).drop("hit")


def inertia_until(log: DataFrame, energy: float, target: float, total: float) -> DataFrame:
    """Energy placed at each node until what is left falls below ``target`` of ``total``: node_idx, energy.

    ``log`` has step, node_idx and gain; if the target isn't reached, all steps count.
    """
    before = F.coalesce(F.sum("gain").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    used = log.withColumn("before", before).where(total - F.col("before") >= target * total)
    return used.groupBy("node_idx").agg((F.count("*") * energy).alias("energy"))
