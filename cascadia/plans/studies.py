"""Further queries: selections and checks, units, capacities, reinforcements, and rankings of clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import bin_index, clip_to
from ..operators import dispatch as D
from ..operators import frames as T
from ..operators import grid as G
from ..operators import mitigation as M
from ..operators import planning as N
from ..operators import splits as S
from ..operators import vectors as V
from ..sources import projections as P
from .catalog import _BIN5, _C, _CAP, _FAIL, _G, _I, _K, _L, _NORM, _PAIR, _S, _T, ORACLE_SQL, QUERIES, _balance, _edges, _failed, _g, _lines, _norm, _pairs, _query, _t, _types, _with, _x

__all__ = ["ORACLE_SQL", "QUERIES"]

_n = lambda s, d: P.read(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("node"), F.col("n_regionkey").alias("group"))
_ED = "ed AS (SELECT (row_number() OVER (ORDER BY u, v) - 1)::INT AS e, u::INT AS u, v::INT AS v FROM (SELECT least(n_nationkey, (n_nationkey + k) % 25) AS u, greatest(n_nationkey, (n_nationkey + k) % 25) AS v FROM nation, (VALUES (1), (5)) t(k)))"
_PAR = "(CASE e % 5 WHEN 0 THEN 1.0e0 WHEN 1 THEN 2.0e0 WHEN 2 THEN 0.57894737e0 WHEN 3 THEN 1.28947368e0 ELSE 3.0e0 END)"

# Selections.
_query("scenario_filter", lambda s, d: T.scenario(_S(s, d), 0.3, 1e-6).select("split_number", "co2l"), _x("split_number, co2l FROM spl WHERE abs(co2l - 0.3) < 1e-6"), 6, "co2l")
_query("scenario_faults", lambda s, d: T.exactly_one(P.read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "\nSELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) <> 1")
_query("snapshot_positions", lambda s, d: T.snapshots_by(_G(s, d), [0, 5, -1]), _g("DISTINCT snapshot FROM (SELECT snapshot, dense_rank() OVER (ORDER BY snapshot) AS a, dense_rank() OVER (ORDER BY snapshot DESC) AS z FROM gen) WHERE a IN (1, 6) OR z = 1"))
_query("large_blackouts", lambda s, d: T.larger_blackouts(_S(s, d), 0.25).select("split_number", F.lit("blackout").alias("kind")).union(T.larger_blackouts(_S(s, d), 0.25, True).select("split_number", F.lit("total"))), _x("split_number, 'blackout' AS kind FROM spl WHERE lost_load_share_blackout > 0.25 UNION ALL SELECT split_number, 'total' FROM spl WHERE lost_load_share_total > 0.25"))
_query("least_share", lambda s, d: T.least_share(_C(s, d), 0.1, True).select("split_number", "component_number"), _x("split_number, component_number FROM obs WHERE load_share > 0.1"))
_query("subsample", lambda s, d: T.subsample(_S(s, d).select("co2l", "split_number"), ["split_number"], "co2l", fraction=0.3).groupBy("co2l").agg(F.count("*").alias("n")), _x("co2l, floor(count(*)*0.3e0)::BIGINT AS n FROM spl GROUP BY 1 HAVING floor(count(*)*0.3e0) > 0"), 6, "co2l")


def _nice(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame([("click", "Wind"), ("view", "Solar"), ("purchase", "Hydro")], "name string, nice_name string")
    return T.renamed(_G(s, d).select("carrier", "p"), "carrier", names).groupBy("carrier").agg(F.sum("p").alias("p"))


_query("nice_names", _nice, _g("CASE carrier WHEN 'click' THEN 'Wind' WHEN 'view' THEN 'Solar' WHEN 'purchase' THEN 'Hydro' ELSE carrier END AS carrier, sum(p) AS p FROM gen GROUP BY 1"), 5, "p")
_query("attribute_lookup", lambda s, d: T.looked_up(_K(s, d).select("bus0", "p0"), "bus0", P.read(s, d, "nation"), "n_nationkey", "n_name").groupBy("n_name").agg(F.sum("p0").alias("p0")), _with("links", "", "n_name, sum(p0) AS p0 FROM links LEFT JOIN nation ON n_nationkey = bus0 GROUP BY 1"), 2, "p0")
_query("without_reinforced", lambda s, d: T.without_triggers(_S(s, d), _edges(s, d).where("edge in (1, 7, 20)")).groupBy("co2l").agg(F.count("*").alias("n"), F.sum("total_weighting").alias("weight")), _x("co2l, count(*) AS n, sum(total_weighting)::BIGINT AS weight FROM spl WHERE init_failure_0 NOT IN (1, 7, 20) AND init_failure_1 NOT IN (1, 7, 20) GROUP BY 1"), 6, "co2l")
_query("trigger_pair", lambda s, d: T.with_trigger_pair(_S(s, d), 17, 4).select("split_number"), _x("split_number FROM spl WHERE (init_failure_0 = 4 AND init_failure_1 = 17) OR (init_failure_0 = 17 AND init_failure_1 = 4)"))
_query("spread_labels", lambda s, d: T.spread_labels(_T(s, d).groupBy("v").agg(F.min("vec_id").alias("label")), _T(s, d).select("vec_id", "v"), "v"), _t("vec_id, min(vec_id) OVER (PARTITION BY v) AS label FROM tern"))
_query("subset_check", lambda s, d: T.missing_from(P.read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), P.read(s, d, "customer"), "c_custkey").agg(F.count("*").alias("missing")), "\nSELECT count(DISTINCT o_custkey) AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
_query("common_lines", lambda s, d: T.common(P.read(s, d, "lineitem").select(F.col("l_suppkey").alias("line")), P.read(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("line")), "line"), "\nSELECT l_suppkey AS line FROM lineitem INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")


def _rebuilt(s: SparkSession, d: str) -> DataFrame:
    cols = ["time_stamp", "init_failure_0", "init_failure_1", "n_components", "total_weighting"]
    other = _S(s, d).withColumn("total_weighting", F.when(F.col("split_number") % 97 == 0, F.col("total_weighting") + 1).otherwise(F.col("total_weighting")))
    return T.same_rows(_S(s, d), other, cols).groupBy("side").agg(F.count("*").alias("n"))


_query("rebuilt_index", _rebuilt, _x("""side, count(*) AS n FROM (SELECT * FROM (SELECT 'first' AS side, * FROM (SELECT time_stamp, init_failure_0, init_failure_1, n_components, total_weighting FROM spl EXCEPT ALL SELECT time_stamp, init_failure_0, init_failure_1, n_components, CASE WHEN split_number % 97 = 0 THEN total_weighting + 1 ELSE total_weighting END FROM spl))
  UNION ALL SELECT * FROM (SELECT 'second' AS side, * FROM (SELECT time_stamp, init_failure_0, init_failure_1, n_components, CASE WHEN split_number % 97 = 0 THEN total_weighting + 1 ELSE total_weighting END AS total_weighting FROM spl EXCEPT ALL SELECT time_stamp, init_failure_0, init_failure_1, n_components, total_weighting FROM spl))) GROUP BY 1"""))
_country = lambda s, d: _C(s, d).join(P.read(s, d, "nation"), F.col("n_nationkey") == F.col("node_idx")).select(F.substring("n_name", 1, 2).alias("country"), F.round(F.col("co2l") * 10).cast("int").alias("level"), "load")
_WIDE = ", ".join(f'sum(load) FILTER (round(co2l*10) = {k}) AS "{k}"' for k in range(8))
_query("country_series", lambda s, d: T.wide(_country(s, d), "country", "level", "load", list(range(8))), _x(f"substr(n_name, 1, 2) AS country, {_WIDE} FROM obs JOIN nation ON n_nationkey = node_idx GROUP BY 1"), 2, " ".join(f'"{k}"' for k in range(8)))
_query("country_series_long", lambda s, d: T.long(T.wide(_country(s, d), "country", "level", "load", list(range(8))), "country", [str(k) for k in range(8)], "level", "load"), _x("substr(n_name, 1, 2) AS country, round(co2l*10)::INT::VARCHAR AS level, sum(load) AS load FROM obs JOIN nation ON n_nationkey = node_idx GROUP BY 1, 2"), 2, "load")
_query("aligned_frames", lambda s, d: T.aligned_sum(_G(s, d).where("carrier <> 'click'"), _G(s, d).where("carrier <> 'view'").withColumn("p", F.col("p") / 2), ["snapshot", "carrier"], "p"), _g("snapshot, carrier, sum(p*(CASE WHEN carrier <> 'click' THEN 1e0 ELSE 0e0 END + CASE WHEN carrier <> 'view' THEN 0.5e0 ELSE 0e0 END)) AS p FROM gen GROUP BY 1, 2"), 6, "p")
_query("time_batches", lambda s, d: T.time_batches(_G(s, d).select("snapshot").distinct(), "snapshot", 7).groupBy("batch").agg(F.count("*").alias("n")), _g("least(6, floor((epoch(snapshot) - lo)*7/(hi - lo)))::INT AS batch, count(*) AS n FROM (SELECT DISTINCT snapshot FROM gen), (SELECT min(epoch(snapshot)) AS lo, max(epoch(snapshot)) AS hi FROM gen) GROUP BY 1"))
_query("step_size", lambda s, d: T.step_size(_G(s, d)), _g("median(gap)::DOUBLE AS seconds, 86400/median(gap) AS per_day FROM (SELECT epoch(snapshot) - lag(epoch(snapshot)) OVER (ORDER BY snapshot) AS gap FROM (SELECT DISTINCT snapshot FROM gen)) WHERE gap IS NOT NULL"), 6, "seconds per_day")


def _mean_loading(s: SparkSession, d: str) -> DataFrame:
    return P.loadings(s, d).groupBy("line").agg(F.round(F.avg("dc"), 9).alias("loading"))


_NL = "ml AS (SELECT line, round(avg(dc), 9) AS loading FROM loading GROUP BY 1), a AS (SELECT 0.2e0 AS target, line, loading FROM ml ORDER BY abs(loading - 0.2e0), line LIMIT 2), b AS (SELECT 0.3e0 AS target, line, loading FROM ml WHERE line NOT IN (SELECT line FROM a) ORDER BY abs(loading - 0.3e0), line LIMIT 2), c AS (SELECT 0.31e0 AS target, line, loading FROM ml WHERE line NOT IN (SELECT line FROM a UNION SELECT line FROM b) ORDER BY abs(loading - 0.31e0), line LIMIT 2)"
_query("nearest_lines", lambda s, d: T.nearest_lines(_mean_loading(s, d), [0.2, 0.3, 0.31]), _with("loading", _NL, "* FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)"), 9, "target loading")
_query("ratio_histogram", lambda s, d: T.ratio_histogram(P.loadings(s, d), F.col("ac") / F.col("dc"), 1.0, 1.5, 20), _with("loading", "", "CASE WHEN r >= 1 AND r < 1.5 THEN least(19, floor((r - 1)/0.025e0)) ELSE -1 END::INT AS bin, count(*) AS n FROM (SELECT ac/dc AS r FROM loading WHERE dc <> 0) WHERE r <> 0 GROUP BY 1"))
_query("kind_series", lambda s, d: T.series_by_kind(_G(s, d), {"renewable": ["cli", "view"], "nuclear": ["purch"], "storage": ["battery"]}), _g("snapshot, coalesce(sum(p*sign) FILTER (carrier LIKE '%cli%' OR carrier LIKE '%view%'), 0) AS renewable, coalesce(sum(p*sign) FILTER (carrier LIKE '%purch%'), 0) AS nuclear, 0e0 AS storage FROM gen GROUP BY 1"), 6, "renewable nuclear storage")
_query("daily_profile", lambda s, d: _S(s, d).groupBy(F.dayofyear("time_stamp").alias("day")).agg(F.count("*").alias("n"), F.sum("total_weighting").alias("weight")), _x("dayofyear(time_stamp)::INT AS day, count(*) AS n, sum(total_weighting)::BIGINT AS weight FROM spl GROUP BY 1"))
_query("hourly_profile", lambda s, d: P.read(s, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / P.read(s, d, "events").count()), "\nSELECT hour(ts)::INT AS hour, count(*) AS n, count(*)/sum(count(*)) OVER () AS share FROM events GROUP BY 1", 9, "share")

# Units and capacities.
_MEM = "mem AS (SELECT split_number, component_number, n_nationkey::INT AS node FROM (SELECT split_number, component_number, count(*) OVER (PARTITION BY split_number) AS n FROM comp) JOIN nation ON n_nationkey % n = component_number)"


def _unit_parts(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    per = _G(s, d).groupBy("bus", "carrier").agg(F.avg("p").alias("p"), F.max("p_nom").alias("p_nom"), F.max("sign").alias("sign")).withColumn("p_max_pu", F.lit(0.8))
    c = P.split_components(s, d).select("split_number", "component_number").withColumn("n", F.count("*").over(_by_split()))
    nodes = P.read(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("node"))
    # A component takes the nodes of its own remainder: their arithmetic sequence, not a product of all.
    members = c.select("split_number", "component_number", F.explode(F.expr("sequence(int(component_number), 24, int(n))")).alias("node")).join(nodes, "node")
    loads = _L(s, d).groupBy("bus").agg((F.sum("p") / 1e6).alias("p")).withColumn("bus", F.col("bus").cast("int"))
    links = _K(s, d).groupBy(F.col("bus0").cast("int").alias("bus")).agg((F.sum("p0") / 1e7).alias("p"))
    return members, per.where("carrier <> 'signup'"), per.where("carrier = 'signup'"), loads, links


def _by_split():
    from pyspark.sql import Window

    return Window.partitionBy("split_number")


_UNI = _MEM + """, per AS (SELECT bus, carrier, avg(p) AS p, max(p_nom) AS p_nom, max(sign) AS sign FROM gen GROUP BY 1, 2),
pbus AS (SELECT bus, coalesce(sum(p*sign) FILTER (carrier <> 'signup'), 0) AS generation, coalesce(sum(p*sign) FILTER (carrier = 'signup'), 0) AS storage, sum(CASE WHEN p > 0.05e0*0.8e0*p_nom THEN 0.8e0*p_nom*CASE carrier WHEN 'click' THEN 5.9e0 WHEN 'view' THEN 4.2e0 WHEN 'purchase' THEN 3.7e0 ELSE 0e0 END ELSE 0e0 END) AS energy FROM per GROUP BY 1),
lbus AS (SELECT bus, sum(p)/1e6 AS load FROM loads GROUP BY 1), hbus AS (SELECT bus0 AS bus, sum(p0)/1e7 AS hvdc FROM links GROUP BY 1),
roll AS (SELECT split_number, component_number, count(*) AS n_nodes, sum(coalesce(generation, 0)) AS generation, sum(coalesce(storage, 0)) AS storage, sum(coalesce(load, 0)) AS load, sum(coalesce(hvdc, 0)) AS hvdc, sum(coalesce(energy, 0)) AS rot_energy_gen
  FROM mem LEFT JOIN pbus ON pbus.bus = node LEFT JOIN lbus ON lbus.bus = node LEFT JOIN hbus ON hbus.bus = node GROUP BY 1, 2)"""
_query("unit_rollup", lambda s, d: N.unit_rollup(*_unit_parts(s, d), P.INERTIA), _with("comp gen loads links", _UNI, "*, generation + storage - load - hvdc AS power_imbalance, load/sum(load) OVER (PARTITION BY split_number) AS load_share FROM roll"), 4, "generation storage load hvdc rot_energy_gen power_imbalance load_share")
_units = lambda s, d: _G(s, d).select("bus", "carrier", "p_nom").distinct()
_query("storage_energy", lambda s, d: N.storage_energy(_units(s, d).where("carrier in ('signup', 'error')").withColumn("max_hours", F.when(F.col("carrier") == "signup", 6.0).otherwise(2.0)).withColumn("efficiency", F.lit(0.9))), _g("bus, carrier, sum(p_nom*0.9e0*CASE carrier WHEN 'signup' THEN 6e0 ELSE 2e0 END) AS energy FROM (SELECT DISTINCT bus, carrier, p_nom FROM gen) WHERE carrier IN ('signup', 'error') GROUP BY 1, 2"), 6, "energy")
_query("capacity_by_bus", lambda s, d: N.capacity_by_bus(_units(s, d), ["error"]), _g("bus, carrier, capacity, sum(capacity) OVER (PARTITION BY carrier) AS carrier_total FROM (SELECT bus, carrier, sum(p_nom) AS capacity FROM (SELECT DISTINCT bus, carrier, p_nom FROM gen) WHERE carrier <> 'error' GROUP BY 1, 2)"), 6, "capacity carrier_total")
_query("power_factors", lambda s, d: G.power_factors(_types(s, d)).select("bus", "kind", F.coalesce(F.col("factor").between(0.925, 0.975), F.lit(False)).alias("has_factor"), F.round((F.cos(F.atan("tangent")) - F.coalesce("factor", F.lit(1.0))), 9).alias("gap")), _g("bus, kind, kind = 'PQ' AS has_factor, 0e0 AS gap FROM typ", _CAP), 9, "gap")
_query("extension_rescale", lambda s, d: N.rescaled(P.read(s, d, "part").select(F.col("p_partkey").alias("line"), F.col("p_retailprice").alias("s_nom"), (F.col("p_retailprice") * (1 + F.col("p_size") / 50)).alias("s_nom_opt"), (F.col("p_size") / 100.0).alias("x_pu_eff"), F.lit(2.5).alias("i_nom"), F.lit(380.0).alias("v_nom"))), "\nSELECT p_partkey AS line, p_retailprice*(1 + p_size/50e0) AS s_nom, p_size/100e0/(1 + p_size/50e0) AS x_pu_eff, p_retailprice*(1 + p_size/50e0)/(sqrt(3e0)*2.5e0*380e0) AS num_parallel FROM part", 6, "s_nom x_pu_eff num_parallel")
_query("capacity_extension", lambda s, d: N.extended(P.edges(s, d), S.edge_impact(_S(s, d)).select("edge", F.round("weighted_impact", 6).alias("value")), 10), _x(f"e AS edge_idx, u, v, (1 + (e*7 % 13)/10e0)*(par + more)/par AS weight, (400e0 + 50*(e % 9))*(par + more)/par AS s_nom, par + more AS num_parallel, more > 0 AS chosen FROM (SELECT *, {_PAR} AS par, CASE WHEN e IN (SELECT edge FROM imp ORDER BY round(weighted_impact, 6) DESC, edge LIMIT 10) THEN 1e0 ELSE 0e0 END AS more FROM ed)", _ED + ", imp AS (SELECT edge, sum(lost_load_share_blackout*total_weighting) AS weighted_impact FROM (SELECT init_failure_0 AS edge, * FROM spl UNION ALL SELECT init_failure_1 AS edge, * FROM spl WHERE init_failure_0 <> init_failure_1) GROUP BY 1)"), 6, "weight s_nom num_parallel")
_query("circuit_partition", lambda s, d: N.partition(P.read(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 0.25).alias("weight")), (1.0, 0.5, 0.75)), "WITH tri AS (SELECT a.range AS a, b.range AS b, c.range AS c, a.range*1e0 + b.range*0.5e0 + c.range*0.75e0 AS w FROM range(13) a, range(13) b, range(13) c)\nSELECT p_partkey AS id, p_size*0.25e0 AS weight, (SELECT first([a::INT, b::INT, c::INT] ORDER BY a, b, c) FROM tri WHERE abs(w - p_size*0.25e0) <= 1e-6) AS c FROM part", 6, "weight")
_query("largest_circuit", lambda s, d: N.largest_circuit(G.circuits(_lines(s, d))), "\nSELECT s_suppkey AS line, CASE s_suppkey % 5 WHEN 2 THEN 0.28947e0 ELSE 1e0 END AS largest FROM supplier", 5, "largest")
_query("outage_parts", lambda s, d: N.outage_parts(_lines(s, d).join(N.largest_circuit(G.circuits(_lines(s, d))), "line").select(F.col("line").cast("string").alias("name"), "num_parallel", "largest", (100.0 + F.col("line") % 7).alias("s_nom"))), "WITH l AS (SELECT s_suppkey AS i, CASE s_suppkey % 5 WHEN 0 THEN 1e0 WHEN 1 THEN 2e0 WHEN 2 THEN 0.57894737e0 WHEN 3 THEN 1.28947368e0 ELSE 3e0 END AS par, CASE s_suppkey % 5 WHEN 2 THEN 0.28947e0 ELSE 1e0 END AS one, 100e0 + s_suppkey % 7 AS lim FROM supplier)\nSELECT name, num_parallel, s_nom FROM (SELECT i || '_outage' AS name, least(one, par) AS num_parallel, lim*least(one, par)/par*1.01e0 AS s_nom FROM l UNION ALL SELECT i::VARCHAR, par - least(one, par), lim*(par - least(one, par))/par*1.01e0 FROM l WHERE par - least(one, par) > 1e-8)", 6, "num_parallel s_nom")
_query("artificial_units", lambda s, d: N.artificial_units(P.read(s, d, "supplier").select(F.col("s_suppkey").alias("bus"))), "\nSELECT s_suppkey || ' ' || c AS name, s_suppkey AS bus, c AS carrier, g AS sign FROM supplier, (VALUES ('load', 1e-3), ('art_load', -1e-3)) t(c, g)", 6, "sign")


def _deliveries(s: SparkSession, d: str) -> DataFrame:
    """Orders as edges from their supplier's to their customer's nation."""
    li, su, o, c = (P.read(s, d, x) for x in ("lineitem", "supplier", "orders", "customer"))
    j = li.select("l_orderkey", "l_suppkey").distinct().join(su.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("u")), "l_suppkey").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return j.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("v")), "o_custkey").select(F.concat_ws("-", "l_orderkey", "l_suppkey").alias("edge_idx"), "u", "v")


_query("crossing_edges", lambda s, d: N.crossing_edges(_deliveries(s, d), _n(s, d)), "\nSELECT DISTINCT l_orderkey || '-' || l_suppkey AS edge_idx, a.n_regionkey AS group_u, b.n_regionkey AS group_v, a.n_regionkey <> b.n_regionkey AS crosses FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey")
_query("splits_with_edge", lambda s, d: N.splits_with_edge(_failed(s, d), _C(s, d).groupBy("split_number", "component_number").agg(F.count("*").alias("n_nodes")), 7), _x("split_number, list(1::BIGINT) AS sizes FROM obs WHERE split_number IN (SELECT split_number FROM fal WHERE edge = 7) GROUP BY 1", _FAIL))
_query("spi", lambda s, d: N.inhomogeneity(D.dipole(_I(s, d)), 50.0, 10.0, 1e8), _with("inj", "dip AS (SELECT snapshot, sum((node_idx % 5 - 2e0)*p0) AS x, sum((floor(node_idx/5e0) - 2e0)*p0) AS y FROM inj GROUP BY 1)", "snapshot, 2*6371.0088e0*asin(least(1e0, sqrt(power(sin(radians(y/1e8)/2), 2) + cos(radians(50e0))*cos(radians(50 + y/1e8))*power(sin(radians(x/1e8)/2), 2)))) AS km FROM dip"), 4, "km")

# Vectors and clusters.
_query("failed_edge_vector", lambda s, d: N.failed_edge_vector(_failed(s, d), 50), "WITH fal AS (SELECT DISTINCT l_orderkey AS split_number, (l_partkey % 50)::INT AS edge FROM lineitem)\nSELECT split_number, list_transform(range(0, 50), lambda i: list_contains(e, i::INT)) AS v FROM (SELECT split_number, list(edge) AS e FROM fal GROUP BY 1)")
_query("component_vectors", lambda s, d: N.component_vectors(_T(s, d), "vec_id", "v"), _t("q.vec_id, q.value::INT AS value, list_transform(q.v, lambda e: (e = q.value)::INT) AS v FROM q WHERE value <> main", "u AS (SELECT vec_id, v, unnest(v) AS value FROM tern), q AS (SELECT vec_id, value, any_value(v) AS v, first_value(value) OVER (PARTITION BY vec_id ORDER BY count(*) DESC, value) AS main FROM u GROUP BY vec_id, value)"))
_query("load_vectors", lambda s, d: N.load_vectors(_C(s, d), P.NODES, 0.3).select("split_number", "weight", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("load"), F.size(F.filter("mask", lambda m: m)).alias("n"), F.size("v").alias("size")), _x("split_number, (min(trigger_weighting)*3)::BIGINT AS weight, sum(load) AS load, count(DISTINCT node_idx) FILTER (load > 0)::INT AS n, 25 AS size FROM obs WHERE abs(co2l - 0.3) < 1e-9 GROUP BY 1"), 3, "load")
_clusters = lambda s, d: _S(s, d).withColumn("label", F.col("n_components").cast("int"))
_query("edge_centroids", lambda s, d: N.edge_centroids(_failed(s, d), _clusters(s, d).select("split_number", "label", F.col("total_weighting").alias("weight")), _edges(s, d)), _x("c.label, e.range::INT AS edge, coalesce(hit, 0)/whole::DOUBLE AS share FROM (SELECT n_components::INT AS label, sum(total_weighting) AS whole FROM spl GROUP BY 1) c CROSS JOIN range(50) e LEFT JOIN (SELECT n_components::INT AS label, edge, sum(total_weighting) AS hit FROM fal JOIN spl USING (split_number) GROUP BY 1, 2) h ON h.label = c.label AND h.edge = e.range", _FAIL), 9, "share")
_query("cluster_histogram", lambda s, d: N.cluster_histogram(_clusters(s, d), _norm(s, d), bin_index(clip_to(F.col("lost_load_share_blackout") * 100, 0.0, 100.0), 0.0, 100.0, 5)), _x(f"label, co2l, bin, w/norm AS fraction FROM (SELECT n_components::INT AS label, co2l, {_BIN5} AS bin, sum(total_weighting) AS w FROM spl GROUP BY 1, 2, 3) JOIN nrm USING (co2l)", _NORM), 12, "co2l fraction")


def _scores(s: SparkSession, d: str) -> DataFrame:
    sil = V.hamming_silhouette(_T(s, d), "vec_id", "v", "label")
    return sil.select("i", "label", F.round("silhouette", 9).alias("score"))


_index = lambda s, d: N.result_index(_scores(s, d), F.concat(F.lit("a"), (F.col("i") % 2).cast("string")), F.concat(F.lit("k="), (F.col("i") % 7).cast("string")))
_SIL = _PAIR + """, sl AS (SELECT vec_id AS i, label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a)/greatest(a, b) END, 9) AS score FROM (SELECT vec_id, label, min(d) FILTER (label = l) AS a, min(d) FILTER (label <> l) AS b FROM (SELECT t.vec_id, t.label, u.label AS l, avg(d) AS d FROM tern t JOIN (SELECT i, j, d FROM ham UNION ALL SELECT j, i, d FROM ham) p ON p.i = t.vec_id JOIN tern u ON u.vec_id = p.j GROUP BY 1, 2, 3) GROUP BY 1, 2)),
ix AS (SELECT 'a' || i % 2 AS algorithm, 'k=' || i % 7 AS params, count(DISTINCT label) AS n_clusters, count(*) AS n_samples, round(avg(score), 9) + 0e0 AS score FROM sl GROUP BY 1, 2)"""
_query("result_index", _index, _t("*, row_number() OVER (PARTITION BY algorithm ORDER BY round(score, 6) DESC, params) = 1 AS best FROM ix", _SIL), 6, "score")
_query("best_results", lambda s, d: N.best_results(_index(s, d), "n_samples", most=3).select("algorithm", "params", "n_samples", "rank"), _t("algorithm, params, n_samples, row_number() OVER (PARTITION BY algorithm ORDER BY n_samples DESC, params)::INT AS rank FROM ix QUALIFY rank <= 3", _SIL))

# Reinforcements.
_query("severity_weights", lambda s, d: N.severity_weights(_C(s, d).select("split_number", "component_number"), _S(s, d).withColumn("lost_load_share_blackout", F.round("lost_load_share_blackout", 9)), 0.5), _x("split_number, component_number, (round(lost_load_share_blackout, 9) > 0.5)::INT AS mitigation_weighting FROM obs JOIN (SELECT split_number, lost_load_share_blackout FROM spl) USING (split_number)"))
_daily = lambda s, d: _S(s, d).groupBy(F.month("time_stamp").alias("step")).agg(F.round(F.sum("lost_load_share_blackout"), 6).alias("gain"))
_MON = "mon AS (SELECT month(time_stamp)::INT AS step, round(sum(lost_load_share_blackout), 6) AS gain FROM spl GROUP BY 1)"
_query("placement_progress", lambda s, d: N.placement_progress(_daily(s, d), F.lit(500.0), F.lit(40)), _x("step, sum(gain) OVER (ORDER BY step)/500e0 AS mitigated, sum(gain) OVER (ORDER BY step)/40e0 AS gain_by_component FROM mon", _MON), 9, "mitigated gain_by_component")
_query("inertia_until", lambda s, d: N.inertia_until(_daily(s, d).withColumn("node_idx", F.col("step") % 5), 5000.0, 0.6, 1000.0), _x("node_idx::INT AS node_idx, count(*)*5000e0 AS energy FROM (SELECT step % 5 AS node_idx, coalesce(sum(gain) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM mon) WHERE 1000 - b >= 600 GROUP BY 1", _MON), 3, "energy")


def _sweep(s: SparkSession, d: str) -> DataFrame:
    """Gain of one step of energy at each node, for all scenarios and several energies at once."""
    c = _C(s, d).withColumn("energy", F.explode(F.array(*map(F.lit, (1000.0, 5000.0, 20000.0)))))
    return M.inertia_sweep(c)


_query("inertia_sweep", _sweep, _x("energy::DOUBLE AS energy, co2l, node_idx, sum(load_share*trigger_weighting*snapshot_weighting) AS gain FROM obs, (VALUES (1000e0), (5000e0), (20000e0)) t(energy) WHERE abs(50e0*power_imbalance/(2*rot_energy)) > 1 AND abs(50e0*power_imbalance/(2*(rot_energy + energy))) < 1 GROUP BY 1, 2, 3"), 5, "energy co2l gain")
