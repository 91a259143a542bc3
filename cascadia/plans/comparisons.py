"""Queries that set studies side by side: distances of flows, batches, calendars, main components, walks between classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dispatch as D
from ..operators import planning as N
from ..operators import splits as S
from ..operators import vectors as V
from ..sources import artifacts as A
from ..sources import projections as P
from .campaigns import _MEMB, _SYM, ORACLE_SQL, QUERIES
from .catalog import _C, _G, _I, _M, _S, _g, _query, _with, _x

__all__ = ["ORACLE_SQL", "QUERIES"]


# Distances that flows go, by snapshot, and their histogram.
def _transmitted(s: SparkSession, d: str) -> DataFrame:
    """What the nations' suppliers give; flows within a nation, less a fixed part, stand for storage units."""
    x = P.dated_links(s, d)
    made = x.where("bus0 <> bus1").groupBy("co2l", "snapshot", "bus0").agg(F.sum("p0").alias("p")).withColumn("sign", F.lit(1))
    return D.transmitted_power(made, x.where("bus0 = bus1").withColumn("p", F.col("p0") - 20000.0))


_TRANSMITTED = """trn AS (SELECT co2l, snapshot, sum(CASE WHEN bus0 <> bus1 THEN p0 WHEN p0 > 20000 THEN p0 - 20000 ELSE 0e0 END) AS p FROM dlinks WHERE bus0 <> bus1 OR p0 > 20000 GROUP BY 1, 2),
dst AS (SELECT co2l, snapshot, sum(abs(p0)*length) AS x FROM dlinks GROUP BY 1, 2)"""
_query(
    "flow_distance_series",
    lambda s, d: D.flow_distances(P.dated_links(s, d)).join(D.flow_distances(P.dated_links(s, d), _transmitted(s, d)).withColumnRenamed("flow_distance", "mean_distance"), ["co2l", "snapshot"]),
    _with("dlinks", _TRANSMITTED, "co2l, snapshot, x/1e6 AS flow_distance, x/p AS mean_distance FROM dst LEFT JOIN trn USING (co2l, snapshot)"),
    6,
    "co2l flow_distance mean_distance",
)


def _distance_histogram(s: SparkSession, d: str) -> DataFrame:
    series = A.scratch(D.flow_distances(P.dated_links(s, d)).withColumn("flow_distance", F.round("flow_distance", 9)))
    return D.distance_histogram(series, series.select("co2l", "snapshot", F.dayofmonth(F.last_day("snapshot")).alias("w")))


_query(
    "flow_distance_histogram",
    _distance_histogram,
    _with("dlinks", _TRANSMITTED + """,
ser AS (SELECT co2l, round(x/1e6, 9) AS v, day(last_day(snapshot)) AS w, min(round(x/1e6, 9)) OVER () AS low, max(round(x/1e6, 9)) OVER () AS high FROM dst),
bns AS (SELECT co2l, CASE WHEN v = high THEN 38 ELSE least(38, floor((v - low)/((high - low)/39)))::INT END AS bin, sum(w) AS w FROM ser GROUP BY 1, 2)""", "co2l, bin, w/whole::DOUBLE AS share FROM bns JOIN (SELECT co2l, sum(w) AS whole FROM ser GROUP BY 1) USING (co2l)"),
    9,
    "co2l share",
)

# Cases of a study in batches against those of an old one.
_BATCHED = lambda s, d: _C(s, d).select("time_stamp", F.col("init_failure_0").alias("edge_0"), F.col("init_failure_1").alias("edge_1"), F.col("component_number").cast("int").alias("circuits_0"), F.col("node_idx").alias("circuits_1"), (F.col("split_number") % 11 > 0).alias("splits"))
_LARGEST = "lrg AS (SELECT time_stamp, init_failure_0 AS edge_0, init_failure_1 AS edge_1, max((component_number::INT, node_idx, split_number % 11 > 0)) AS m FROM obs GROUP BY 1, 2, 3)"
_query("largest_cases", lambda s, d: S.largest_cases(_BATCHED(s, d)), _x("time_stamp, edge_0, edge_1, m[1] AS circuits_0, m[2] AS circuits_1, m[3] AS splits FROM lrg", _LARGEST))
_query(
    "case_counts",
    lambda s, d: S.case_counts(_S(s, d).where("n_components > 2"), _BATCHED(s, d)),
    _x("time_stamp, coalesce(n_old, 0) AS n_old, coalesce(n_batched, 0) AS n_batched, coalesce(n_old, 0) - coalesce(n_batched, 0) AS difference, coalesce(unsplit, 0) AS unsplit FROM (SELECT time_stamp, count(*) AS n_old FROM spl WHERE n_components > 2 GROUP BY 1) FULL JOIN (SELECT time_stamp, count(*) FILTER (m[3]) AS n_batched, count(*) FILTER (NOT m[3]) AS unsplit FROM lrg GROUP BY 1) USING (time_stamp)", _LARGEST),
)
_query("trigger_edges", lambda s, d: S.trigger_edges(_S(s, d)), _x("co2l, init_failure_0 AS edge FROM spl UNION SELECT co2l, init_failure_1 FROM spl"), 6, "co2l")

# Snapshots of the calendar, and loadings at the months with splits.
_query(
    "calendar_filter",
    lambda s, d: D.on_calendar(_G(s, d), seasons=["winter", "summer"], weekdays=[0, 1, 2, 3, 6], hours=[0, 6, 12, 18]).groupBy("snapshot").agg(F.count("*").alias("n"), F.sum("p").alias("p")),
    _g("snapshot, count(*) AS n, sum(p) AS p FROM gen WHERE month(snapshot) IN (12, 1, 2, 6, 7, 8) AND isodow(snapshot) NOT IN (5, 6) AND hour(snapshot) IN (0, 6, 12, 18) GROUP BY 1"),
    5,
    "p",
)


def _at_splits(s: SparkSession, d: str) -> DataFrame:
    """Loadings of lines at the months in which orders split, with and without a threshold, where lines ship in all of these months."""
    loads = A.scratch(P.loadings(s, d).groupBy("snapshot", "line").agg(F.max("dc").alias("loading")))
    month = F.date_trunc("month", "time_stamp").cast("timestamp_ntz")
    splits = A.scratch(_S(s, d).select(month.alias("time_stamp"), F.round("lost_load_share_blackout", 9).alias("lost_load_share_blackout")).join(loads.select(F.col("snapshot").alias("time_stamp")).distinct(), "time_stamp", "left_semi"))
    return D.at_splits(loads, splits).withColumn("over", F.lit("any")).unionByName(D.at_splits(loads, splits, 0.95).withColumn("over", F.lit("severe")))


_query(
    "loadings_at_splits",
    _at_splits,
    _with("comp loading", _x("", "").split("FROM lineitem JOIN orders ON l_orderkey = o_orderkey), ", 1)[1].rsplit("\nSELECT", 1)[0] + """,
mon AS (SELECT date_trunc('month', time_stamp)::TIMESTAMP AS snapshot, max(round(lost_load_share_blackout, 9)) AS most FROM spl GROUP BY 1),
lod AS (SELECT snapshot::TIMESTAMP AS snapshot, line, max(dc) AS loading FROM loading GROUP BY 1, 2)""", "snapshot, line, loading, k AS over FROM lod JOIN mon USING (snapshot), (VALUES ('any', -1), ('severe', 0.95)) v(k, least) WHERE most > least"),
    9,
    "loading",
)

# Main components by load share, nodes in several components, walks between classes, dipoles from the middle of the buses.

def _main_components(s: SparkSession, d: str) -> DataFrame:
    share = F.floor(F.col("load_share") * 20 + 1e-7).cast("int")
    v = _C(s, d).groupBy("split_number").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("component_number").alias("at"), share.alias("x")))), lambda e: e["x"]).alias("v"))
    places = lambda flags: F.array_join(F.transform(flags, lambda x: x.cast("string")), "")
    return v.select("split_number", places(V.main_component(F.col("v"), "largest")).alias("largest"), places(V.main_component(F.col("v"), "most_frequent")).alias("most_frequent"))


_query("main_components", _main_components, _x("split_number, string_agg((x = top)::INT::VARCHAR, '' ORDER BY component_number) AS largest, string_agg((x = mode)::INT::VARCHAR, '' ORDER BY component_number) AS most_frequent FROM (SELECT *, arg_max(x, (n, -first)) OVER (PARTITION BY split_number) AS mode, max(x) OVER (PARTITION BY split_number) AS top FROM cnt) GROUP BY 1", """shr AS (SELECT split_number, component_number, floor(load_share*20 + 1e-7)::INT AS x FROM obs),
cnt AS (SELECT *, count(*) OVER (PARTITION BY split_number, x) AS n, min(component_number) OVER (PARTITION BY split_number, x) AS first FROM shr)"""))
_query("below_zero_vectors", lambda s, d: V.nodal_values(_C(s, d), P.NODES).select("split_number", F.aggregate(V.transformed(F.col("v"), "below_zero"), F.lit(0.0), lambda a, x: a + x).alias("total")), _x("split_number, sum(least(x, 0e0)) AS total FROM (SELECT split_number, node_idx, arg_max(rocof, (abs(rocof), rocof)) AS x FROM obs GROUP BY 1, 2) GROUP BY 1"), 6, "total")
_query("misplaced_nodes", lambda s, d: V.misplaced_nodes(_C(s, d), P.NODES), _x("split_number, count(*) FILTER (k > 1) AS doubled, 25 - count(*) AS missing FROM (SELECT split_number, node_idx, count(DISTINCT component_number) AS k FROM obs GROUP BY 1, 2) GROUP BY 1"))
_query(
    "typed_katz_walks",
    lambda s, d: V.typed_katz_walks(_M(s, d), "split_number", "v", P.edges(s, d)).select("key", F.posexplode("katz").alias("node", "katz")),
    _with("comp", ", ".join((_SYM, _MEMB, """wlk AS (SELECT 1 AS d, i, j, 1e0 AS x FROM sym UNION ALL SELECT w.d + 1, w.i, s.j, sum(w.x) FROM wlk w JOIN sym s ON s.i = w.j WHERE w.d < 10 GROUP BY 1, 2, 3),
wgt AS (SELECT i, j, sum(x*power(0.1e0, d)) AS w FROM wlk GROUP BY 1, 2)""")), "kys.key, wgt.j AS node, sum(CASE WHEN mem.i IS NULL THEN -w ELSE w END) AS katz FROM kys CROSS JOIN wgt LEFT JOIN mem ON mem.key = kys.key AND mem.i = wgt.i GROUP BY 1, 2").replace("WITH ", "WITH RECURSIVE ", 1),
    10,
    "katz",
)
_BUSES = lambda s, d: P.read(s, d, "nation").select((45 + F.floor(F.col("n_nationkey") / 5)).cast("double").alias("lat"), (5.0 + F.col("n_nationkey") % 5).alias("lon"))
_query(
    "spi_of_buses",
    lambda s, d: N.inhomogeneity_at(D.dipole(_I(s, d)), _BUSES(s, d), 1e8),
    _with("inj", "dip AS (SELECT snapshot, sum((node_idx % 5 - 2e0)*p0)/1e8 AS x, sum((floor(node_idx/5e0) - 2e0)*p0)/1e8 AS y FROM inj GROUP BY 1), mid AS (SELECT avg(45 + floor(n_nationkey/5e0)) AS lat FROM nation)", "snapshot, 2*6371.0088e0*asin(least(1e0, sqrt(power(sin(radians(y)/2), 2) + cos(radians(lat))*cos(radians(lat + y))*power(sin(radians(x)/2), 2)))) AS km FROM dip, mid"),
    4,
    "km",
)
