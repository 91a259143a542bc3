"""Queries over whole campaigns: hierarchies of vectors, plans and their replay, outages, weights, draws and studies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dispatch as D
from ..operators import grid as G
from ..operators import linkage as L
from ..operators import mitigation as M
from ..operators import placement as B
from ..operators import splits as S
from ..operators import vectors as V
from ..sources import artifacts as A
from ..sources import gml
from ..sources import projections as P
from .catalog import _C, _I, _M, _NORM, _PAIR, _S, _T, _cost, _pairs, _query, _t, _with, _x
from .studies import _ED, ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]


# Hierarchies of all distinct vectors.
def _unique(s: SparkSession, d: str) -> DataFrame:
    return A.scratch(V.unique_vectors(_T(s, d), "vec_id", "v", "w"))


def _spread(s: SparkSession, d: str, unique: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters of distinct vectors given back to all rows."""
    return _T(s, d).select("vec_id", "v").join(unique.select("uid", "v"), "v").join(clusters.withColumnRenamed("key", "uid"), "uid").drop("uid", "v")


def _agglomerative(linkage: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        u = _unique(s, d)
        tree = A.scratch(L.vector_merge_tree(u, "uid", "v", linkage, V.hamming, A.scratch))
        return _spread(s, d, u, L.cut_tree(tree, u.select(F.col("uid").alias("key")), [16, 64], A.scratch))

    return run


def _density(s: SparkSession, d: str) -> DataFrame:
    u = _unique(s, d)
    return _spread(s, d, u, L.vector_density_clusters(u, "uid", "v", V.hamming, 4, 5, A.scratch))


def _reaching(s: SparkSession, d: str) -> DataFrame:
    x = _T(s, d).select("vec_id", "v")
    return A.scratch(L.reaching(x, "vec_id", "v", A.scratch(L.vector_core_distances(x, "vec_id", "v", V.hamming, 5))))


_query("agglomerative", _agglomerative("average"))
_query("agglomerative_complete", _agglomerative("complete"))
_query("density_hierarchy", _density)
_query("spanning_tree", lambda s, d: L.vector_spanning_tree(_reaching(s, d), "key", "v", "core", L.mutual(V.hamming), A.scratch), digits=9)
_query("mutual_reachability", lambda s, d: V.blocked_pairs(_reaching(s, d), "key", "v", "core", L.mutual(V.hamming), digits=9), _t("i, j, greatest(d, a.core, b.core) AS d FROM ham JOIN cor a ON a.key = i JOIN cor b ON b.key = j", _PAIR + """,
two AS (SELECT i AS key, d FROM ham UNION ALL SELECT j, d FROM ham),
cor AS (SELECT key, max(d) AS core FROM (SELECT key, d, row_number() OVER (PARTITION BY key ORDER BY d) AS r FROM two) WHERE r <= 4 GROUP BY 1)"""), 9, "d", rounds=False)

# Plans of inertia over components with member nodes.
_MEM = lambda s, d: P.member_nodes(_C(s, d).select("co2l", "split_number", "component_number", "time_stamp", "node_idx", "rot_energy", "power_imbalance", "load_share", "snapshot_weighting", (F.col("trigger_weighting") * F.col("snapshot_weighting")).alias("weight")))
_LEVELS = [k / 10 for k in range(8)]
_STEPS = 4


def _plan(rules: tuple[str, ...], energies: tuple[float, ...]):
    def run(s: SparkSession, d: str) -> DataFrame:
        cases = [B.Case(x, e, r) for x in _LEVELS for e in energies for r in rules]
        return B.place_inertia(_MEM(s, d), cases, _STEPS, A.scratch)

    return run


_MEMBERS = "mem AS (SELECT co2l, rot_energy AS rot, power_imbalance AS imb, round(load_share*trigger_weighting*snapshot_weighting/1e-9)::HUGEINT AS whole, list_distinct([node_idx, ((node_idx + component_number + 1) % 25)::INT, ((split_number + component_number) % 25)::INT]) AS nodes FROM obs WHERE abs(50e0*power_imbalance/(2*rot_energy)) > 1)"
_RATE = "abs(50e0*imb/(2*(rot + list_sum(list_transform(nodes, lambda n: placed[n + 1]))%s)))"
#: The placed energies of all nodes go along as a list; each step sums the gains of every node anew.
_PLACE = f"""rec AS (
  SELECT DISTINCT co2l, -1 AS step, list_transform(range(25), lambda k: 0e0) AS placed, 1e0 AS factor, 0e0 AS used, 0 AS node, 0::HUGEINT AS gain, 0::BIGINT AS beyond FROM mem
  UNION ALL
  SELECT co2l, step + 1, CASE WHEN best > 0 THEN list_transform(range(25), lambda k: placed[k + 1] + CASE WHEN k = node THEN factor*5000e0 ELSE 0e0 END) ELSE placed END,
    CASE WHEN best > 0 THEN factor ELSE factor + 1 END, factor, node, best, beyond
  FROM (SELECT co2l, step, placed, factor, max(gain) AS best, min(node) FILTER (gain > top - 10) AS node, max(beyond) AS beyond
    FROM (SELECT *, max(gain) OVER (PARTITION BY co2l) AS top FROM (
      SELECT co2l, step, placed, factor, node::INT AS node, beyond, sum(CASE WHEN eligible THEN whole ELSE 0 END)::HUGEINT AS gain FROM (
        SELECT r.co2l, r.step, r.placed, r.factor, whole, unnest(nodes) AS node, {_RATE % ""} > 1 AND {_RATE % " + factor*5000e0"} < 1 AS eligible, count(*) FILTER ({_RATE % ""} > 1) OVER (PARTITION BY r.co2l) AS beyond
        FROM rec r JOIN mem m ON m.co2l = r.co2l WHERE r.step < {_STEPS - 1})
      GROUP BY 1, 2, 3, 4, 5, 6)) GROUP BY 1, 2, 3, 4))"""
_query("greedy_inertia", lambda s, d: _plan(("smallest",), (5000.0,))(s, d).select("co2l", "step", "node_idx", "factor", "gain", "beyond"), _x("co2l, step, node AS node_idx, used AS factor, gain::DOUBLE*1e-9 AS gain, beyond FROM rec WHERE step >= 0 AND gain > 0", _MEMBERS + ", " + _PLACE).replace("WITH ", "WITH RECURSIVE ", 1), 5, "co2l gain")
_query("placement_sweep", lambda s, d: _plan(("concentrate", "hindsight", "hindsight_concentrate"), (2000.0, 20000.0))(s, d), digits=5)


# What splits become once a plan is carried out within budgets.
def _replayed(s: SparkSession, d: str) -> DataFrame:
    c = _C(s, d).withColumn("mitigated_step", (F.col("component_number") * 400 - 400 + F.col("split_number") % 100).cast("int")).withColumn("blackout", F.round("blackout", 12))
    c = c.withColumn("mitigated_step", F.when(F.col("mitigated_step") < 0, -1).otherwise(F.col("mitigated_step")))
    plan = _S(s, d).groupBy("co2l", F.datediff("time_stamp", F.lit("1995-01-01")).cast("int").alias("step")).agg((F.count("*") * M.INERTIA_COST).alias("cost"))
    return B.severe(B.replay(c, plan, [10_000.0, 100_000.0, 400_000.0]), ["budget", "co2l"])


_query("inertia_replay", _replayed, _x("u.budget, u.co2l, count(*) FILTER (round(lost, 9) >= 0.8) AS n, coalesce(sum(w) FILTER (round(lost, 9) >= 0.8), 0)::BIGINT AS weight FROM (SELECT u.budget, u.co2l, split_number, sum(CASE WHEN m >= 0 AND m <= last_step THEN 0e0 ELSE round(blackout, 12) END) AS lost, min(trigger_weighting*snapshot_weighting) AS w FROM mit JOIN unt u ON u.co2l = mit.co2l GROUP BY 1, 2, 3) u GROUP BY 1, 2", """mit AS (SELECT *, CASE WHEN component_number*400 - 400 + split_number % 100 < 0 THEN -1 ELSE component_number*400 - 400 + split_number % 100 END AS m FROM los),
pln AS (SELECT co2l, date_diff('day', DATE '1995-01-01', time_stamp)::INT AS step, count(*)*888.5e0 AS cost FROM spl GROUP BY 1, 2),
tot AS (SELECT *, sum(cost) OVER (PARTITION BY co2l ORDER BY step) AS total FROM pln),
unt AS (SELECT co2l, budget::DOUBLE AS budget, coalesce(max(step) FILTER (total <= budget), -1) AS last_step FROM tot, (VALUES (1e4), (1e5), (4e5)) t(budget) GROUP BY 1, 2)"""), 6, "budget co2l")

# Line extensions until no split is left, over aggregated trigger pairs.
_GREEDY = """par AS (SELECT co2l, init_failure_0 AS e0, init_failure_1 AS e1, sum(lost_load_share_blackout) AS loss, sum(total_weighting)::DOUBLE AS w, sum(lost_load_share_blackout*total_weighting) AS lw FROM spl GROUP BY 1, 2, 3),
stp AS (SELECT DISTINCT target, co2l, 0 AS rank, -1 AS edge, []::INT[] AS gone FROM par, (VALUES ('weight'), ('loss')) t(target)
  UNION ALL
  SELECT target, co2l, rank + 1, edge, list_append(gone, edge) FROM (
    SELECT target, co2l, rank, gone, arg_max(edge, (score, -edge)) AS edge FROM (
      SELECT target, co2l, rank, gone, edge, round(sum(x)/(4.5e6*(1 + edge % 7)), 9) AS score FROM (
        SELECT s.target, s.co2l, s.rank, s.gone, k AS side, CASE WHEN k = 0 THEN e0 ELSE e1 END AS edge, CASE WHEN s.target = 'loss' THEN sum(loss)*sum(w) ELSE sum(w) END AS x
        FROM stp s JOIN par p ON p.co2l = s.co2l AND NOT list_contains(s.gone, e0) AND NOT list_contains(s.gone, e1), (VALUES (0), (1)) v(k) GROUP BY 1, 2, 3, 4, 5, 6)
      GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4))"""
_query("greedy_line_extension", lambda s, d: B.extension_plan(_S(s, d), _cost(s, d)), _x("s.target, s.co2l, s.rank, s.edge, 4.5e6*(1 + s.edge % 7) AS cost, coalesce(sum(lw), 0) AS loss_after, coalesce(sum(w), 0) AS weight_after FROM stp s LEFT JOIN par p ON p.co2l = s.co2l AND NOT list_contains(s.gone, e0) AND NOT list_contains(s.gone, e1) WHERE s.rank > 0 GROUP BY 1, 2, 3, 4", _GREEDY).replace("WITH ", "WITH RECURSIVE ", 1), 4, "co2l cost loss_after weight_after")

# Single outages by factors.
_after = lambda s, d: G.outage_flows(G.dc_flows(P.edges(s, d), _I(s, d)), G.outage_factors(P.edges(s, d)))


def _outage_balance(s: SparkSession, d: str) -> DataFrame:
    """What each node puts in, rebuilt from the flows after each outage."""
    f = _after(s, d).join(F.broadcast(P.edges(s, d).select("edge_idx", "u", "v")), "edge_idx")
    ends = f.select("snapshot", "outage", F.explode(F.array(F.struct(F.col("u").alias("node_idx"), F.col("flow").alias("x")), F.struct(F.col("v").alias("node_idx"), (-F.col("flow")).alias("x")))).alias("e"))
    return ends.groupBy("snapshot", "outage", F.col("e.node_idx").alias("node_idx")).agg((F.sum("e.x") + 0.0037).alias("p0"))


def _outage_loops(s: SparkSession, d: str) -> DataFrame:
    """Whether voltages add up to nothing after each outage, around the loops i, i + 1, i + 6, i + 5 that don't hold the edge."""
    f = _after(s, d).join(F.broadcast(P.edges(s, d).select("edge_idx", "u", "v", "weight")), "edge_idx")
    drop = f.select("snapshot", "outage", F.explode(F.array(F.struct("edge_idx", "u", "v", (F.col("flow") / F.col("weight")).alias("x")), F.struct("edge_idx", F.col("v").alias("u"), F.col("u").alias("v"), (-F.col("flow") / F.col("weight")).alias("x")))).alias("e")).select("snapshot", "outage", "e.*")
    i = P.read(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("loop"))
    around = [F.pmod(F.col("loop") + k, F.lit(25)) for k in (0, 1, 6, 5, 0)]
    sides = i.select("loop", F.explode(F.array(*(F.struct(a.alias("u"), b.alias("v")) for a, b in zip(around, around[1:], strict=False)))).alias("e")).select("loop", "e.u", "e.v")
    whole = drop.join(F.broadcast(sides), ["u", "v"]).groupBy("snapshot", "outage", "loop").agg((F.abs(F.sum("x")) < 1e-6 * (1 + F.max(F.abs("x")))).alias("closed"), F.count_if(F.col("edge_idx") == F.col("outage")).alias("out"))
    return whole.where("out = 0").groupBy("outage", "closed").agg(F.count("*").alias("n"))


_query("outage_balance", _outage_balance, _with("inj", "", "snapshot, e.range::INT AS outage, node_idx::INT AS node_idx, p0 + 0.0037e0 AS p0 FROM inj, range(50) e"), 1, "p0")
_query("outage_loops", _outage_loops, _with("inj", _ED + ", sid AS (SELECT n_nationkey AS loop, least((n_nationkey + a) % 25, (n_nationkey + b) % 25)::INT AS u, greatest((n_nationkey + a) % 25, (n_nationkey + b) % 25)::INT AS v FROM nation, (VALUES (0, 1), (1, 6), (6, 5), (5, 0)) t(a, b)), hol AS (SELECT e AS outage, count(*) AS held FROM sid JOIN ed USING (u, v) GROUP BY 1)", "outage, true AS closed, ((25 - held)*(SELECT count(DISTINCT snapshot) FROM inj))::BIGINT AS n FROM hol"))


# Weights of snapshots where some are missing, and contingencies kept by their network.
def _observed(s: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.abs(F.col("co2l") - 0.3) < 1e-9, 1 + F.dayofmonth("time_stamp") % 2).otherwise(F.col("snapshot_weighting"))
    return P.snapshots(s, d).where("dayofmonth(time_stamp) <> 17 or co2l < 0.05").withColumn("snapshot_weighting", odd)


def _weights(s: SparkSession, d: str) -> DataFrame:
    listed = P.snapshots(s, d).where("abs(co2l - 0.5) > 1e-9").groupBy("co2l").agg(F.count_distinct("time_stamp").alias("n"))
    return S.snapshot_weights(_observed(s, d), listed)


_query("snapshot_weight_fallback", _weights, _x("""co2l, CASE WHEN co2l <> 0.5 AND n > seen AND lo = hi THEN lo*n ELSE total END::DOUBLE AS weight, CASE WHEN co2l <> 0.5 THEN greatest(n - seen, 0) END AS missing, CASE WHEN co2l = 0.5 THEN 'unlisted' WHEN n <= seen THEN 'complete' WHEN lo = hi THEN 'uniform' ELSE 'observed' END AS reason
FROM (SELECT co2l, sum(w) AS total, count(*) AS seen, min(w) AS lo, max(w) AS hi FROM (SELECT DISTINCT co2l, time_stamp, CASE WHEN co2l = 0.3 THEN 1 + day(time_stamp) % 2 ELSE snapshot_weighting END AS w FROM spl WHERE day(time_stamp) <> 17 OR co2l < 0.05) GROUP BY 1)
JOIN (SELECT co2l, count(DISTINCT time_stamp) AS n FROM spl GROUP BY 1) USING (co2l)"""), 6, "co2l weight")


def _cached(s: SparkSession, d: str) -> DataFrame:
    """Contingencies of the network, once computed and once read back from the cache."""
    network, root = P.edges(s, d), A.scratch_root(s) + "/contingencies"
    first = A.cached_for(network, root, lambda _: _pairs(s, d))
    again = A.cached_for(network, root, lambda _: (_ for _ in ()).throw(RuntimeError("the cache was not read")))
    return first.join(again, first.columns)


_query("cached_contingencies", _cached, _x("line_0, size_0, line_1, size_1, weight FROM (SELECT a.line AS line_0, a.size AS size_0, b.line AS line_1, b.size AS size_1, CASE WHEN a.line = b.line AND a.size = b.size THEN a.n*(a.n - 1)/2 ELSE a.n*b.n END AS weight FROM ecr a JOIN ecr b ON b.line > a.line OR (b.line = a.line AND b.size >= a.size)) WHERE weight > 0", _NORM), 7, "size_0 size_1 weight")

# Drawn snapshots, and a study over them that can be resumed.
_TIM = "tim AS (SELECT DISTINCT o_orderdate + to_hours(((o_orderkey % 8)*3)::INT) AS snapshot FROM orders)"
_DRAW = _TIM + """, seas AS (SELECT snapshot, snapshot::DATE AS day, CASE WHEN month(snapshot) IN (12, 1, 2) THEN 'winter' WHEN month(snapshot) <= 5 THEN 'spring' WHEN month(snapshot) <= 8 THEN 'summer' ELSE 'autumn' END AS season FROM tim),
kind AS (SELECT DISTINCT day, season, CASE WHEN isodow(day) = 7 THEN 'sunday' ELSE 'weekday' END AS day_type FROM seas WHERE isodow(day) <> 6),
drw AS (SELECT r::INT AS realization, season, day_type, day FROM (SELECT *, row_number() OVER (PARTITION BY r, season, day_type ORDER BY md5(r::VARCHAR || '|' || strftime(day, '%Y-%m-%d')), day) AS k FROM kind, range(5) t(r)) WHERE k <= CASE WHEN day_type = 'sunday' THEN 1 ELSE 2 END),
sel AS (SELECT realization, drw.season, day_type, time_label, snapshot FROM drw JOIN seas USING (day) JOIN (VALUES ('morning', 6), ('noon', 12), ('evening', 18), ('night', 0)) h(time_label, hr) ON hour(snapshot) = hr)"""
_drawn = lambda s, d: D.drawn_snapshots(P.study_times(s, d), 5)
_query("drawn_snapshots", _drawn, f"WITH {_DRAW}\nSELECT * FROM sel")


def _study(s: SparkSession, d: str) -> DataFrame:
    """Loadings of lines at the months of drawn snapshots, by realization, seed and snapshot; interrupted once on its way."""
    cells = _drawn(s, d).select("realization", "snapshot", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seed"))
    loadings = P.loadings(s, d).select("line", F.col("snapshot").alias("month"), "seed", "dc").groupBy("month", "seed").agg(F.avg("dc").alias("loading"), F.max("dc").alias("most"), F.count("*").alias("lines"))

    def solve(x: DataFrame) -> DataFrame:
        return x.join(loadings, (F.date_trunc("month", x["snapshot"]).cast("timestamp_ntz") == F.col("month")) & (x["seed"] == loadings["seed"]), "left").select(x["realization"], x["seed"], x["snapshot"], "loading", "most", F.coalesce("lines", F.lit(0)).alias("lines"))

    root = A.scratch_root(s) + f"/study-{A.digest(cells)}-{uuid.uuid4().hex}"
    A.run_study(cells, ["realization", "seed", "snapshot"], root, solve, most_lots=7)
    return A.run_study(cells, ["realization", "seed", "snapshot"], root, solve)


_query("resumed_study", _study, _with("loading", _DRAW + ", lod AS (SELECT snapshot AS month, seed, avg(dc) AS loading, max(dc) AS most, count(*) AS n FROM loading GROUP BY 1, 2)", "sel.realization, k.seed::INT AS seed, sel.snapshot, lod.loading, lod.most, coalesce(n, 0) AS lines FROM (SELECT DISTINCT realization, snapshot FROM sel) sel CROSS JOIN (VALUES (1), (2), (3)) k(seed) LEFT JOIN lod ON lod.month = date_trunc('month', sel.snapshot) AND lod.seed = k.seed"), 9, "loading most")


def _graph_files(s: SparkSession, d: str) -> DataFrame:
    """The grid of each level written as graph files and read back."""
    e = P.edges(s, d).withColumn("graph", F.explode(F.array(*(F.lit(f"grid_{x:g}") for x in _LEVELS[:3]))))
    none = F.lit(None).cast("long")
    edges = e.select("graph", F.lit("edge").alias("kind"), none.alias("id"), F.col("u").cast("long").alias("source"), F.col("v").cast("long").alias("target"), F.create_map(F.lit("edge_idx"), F.col("edge_idx").cast("string"), F.lit("weight"), F.col("weight").cast("string")).alias("attributes"))
    nodes = e.select("graph", F.lit("node").alias("kind"), F.explode(F.array(F.col("u").cast("long"), F.col("v").cast("long"))).alias("id")).distinct().select("*", none.alias("source"), none.alias("target"), F.create_map(F.lit("label"), F.concat(F.lit("bus "), F.col("id"))).alias("attributes"))
    folder = A.scratch_root(s) + f"/graphs-{uuid.uuid4().hex}"
    gml.write_graphs(nodes.unionByName(edges), folder)
    g = gml.read_graphs(s, folder)
    return g.select("graph", "kind", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("source", F.lit(-1)).alias("source"), F.coalesce("target", F.lit(-1)).alias("target"), F.col("attributes")["label"].alias("label"), F.col("attributes")["edge_idx"].cast("int").alias("edge_idx"), F.col("attributes")["weight"].cast("double").alias("weight"))


_query("graph_files", _graph_files, f"""WITH {_ED}, lev AS (SELECT * FROM (VALUES ('grid_0'), ('grid_0.1'), ('grid_0.2')) t(graph))
SELECT graph, 'node' AS kind, n_nationkey::BIGINT AS id, -1::BIGINT AS source, -1::BIGINT AS target, 'bus ' || n_nationkey AS label, NULL::INT AS edge_idx, NULL::DOUBLE AS weight FROM nation, lev
  UNION ALL SELECT graph, 'edge', -1, u, v, NULL, e, 1 + (e*7 % 13)/10e0 FROM ed, lev""", 6, "weight")


# Fields over the grid. The other engine gets them from powers of the walk: node by node as rows of matrices.
_SYM = _ED + ", sym AS (SELECT u AS i, v AS j FROM ed UNION ALL SELECT v, u FROM ed), deg AS (SELECT i, count(*) AS n FROM sym GROUP BY 1), nod AS (SELECT n_nationkey::INT AS i FROM nation)"
_MEMB = "mem AS (SELECT DISTINCT split_number AS key, node_idx AS i FROM comp), kys AS (SELECT DISTINCT key FROM mem)"
_WALKS = """wlk AS (SELECT 1 AS d, i, j, 1e0 AS x FROM sym UNION ALL SELECT w.d + 1, w.i, s.j, sum(w.x) FROM wlk w JOIN sym s ON s.i = w.j WHERE w.d < 10 GROUP BY 1, 2, 3),
wgt AS (SELECT i, j, sum(x/total*power(d, -1.5e0)) AS w FROM wlk JOIN (SELECT d, j, sum(x) AS total FROM wlk GROUP BY 1, 2) USING (d, j) GROUP BY 1, 2),
own AS (SELECT kys.key, n.i AS j, coalesce(sum(w) FILTER (mem.i IS NOT NULL), 0) AS one, sum(w) AS whole FROM kys CROSS JOIN nod n JOIN wgt ON wgt.j = n.i LEFT JOIN mem ON mem.key = kys.key AND mem.i = wgt.i GROUP BY 1, 2)"""


def _smooth(alpha: float) -> str:
    return f"""stp AS (SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN {1 - alpha}e0 ELSE 0e0 END + CASE WHEN sym.i IS NOT NULL THEN {alpha}e0/deg.n ELSE 0e0 END AS x FROM nod a CROSS JOIN nod b LEFT JOIN sym ON sym.i = a.i AND sym.j = b.i JOIN deg ON deg.i = a.i),
pow AS (SELECT 1 AS d, i, j, x FROM stp UNION ALL SELECT p.d + 1, p.i, s.j, sum(p.x*s.x) FROM pow p JOIN stp s ON s.i = p.j WHERE p.d < 3 GROUP BY 1, 2, 3),
cut AS (SELECT key, u, v FROM kys, ed WHERE (SELECT count(*) FROM mem WHERE mem.key = kys.key AND mem.i = u) <> (SELECT count(*) FROM mem WHERE mem.key = kys.key AND mem.i = v)),
bnd AS (SELECT key, i FROM (SELECT key, u AS i, 1 AS x FROM cut UNION ALL SELECT key, v, -1 FROM cut) GROUP BY 1, 2 HAVING sum(x) <> 0),
fld AS (SELECT key, sum(pow.x) AS total FROM bnd JOIN pow ON pow.j = bnd.i AND pow.d = 3 GROUP BY 1)"""


_total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
_grid_sql = lambda more, body: _with("comp", ", ".join((_SYM, _MEMB, more)), body).replace("WITH ", "WITH RECURSIVE ", 1)
_query("boundary_field", lambda s, d: V.boundary(_M(s, d), "split_number", "v", P.edges(s, d)).select("key", "boundary", _total("field").alias("total")), _grid_sql(_smooth(0.5), "kys.key, (SELECT count(*) FROM bnd WHERE bnd.key = kys.key)::DOUBLE AS boundary, coalesce(total, 0) AS total FROM kys LEFT JOIN fld USING (key)"), 8, "boundary total")
_query("low_weight_boundary", lambda s, d: V.boundary(_M(s, d), "split_number", "v", P.edges(s, d), 0.4).select("key", F.aggregate("field", F.lit(0.0), lambda a, x: a + 1 - x).alias("far")), _grid_sql(_smooth(0.4), "kys.key, 25 - coalesce(total, 0) AS far FROM kys LEFT JOIN fld USING (key)"), 8, "far")
_query("homogeneity", lambda s, d: V.homogeneity(_M(s, d), "split_number", "v", P.edges(s, d), (0, 1)).select("key", _total("homogeneity").alias("total")), _grid_sql(_WALKS, "key, sum(greatest(0e0, least(1e0, 1 + (one/whole*ln(one/whole + 1e-10) + (1 - one/whole)*ln(1 - one/whole + 1e-10))/ln(2e0)))) AS total FROM own GROUP BY 1"), 7, "total")
_query("typed_katz", lambda s, d: V.typed_katz(_M(s, d), "split_number", "v", P.edges(s, d)).select("key", _total("katz").alias("total")), _grid_sql(_WALKS, "key, sum(abs(2*one - whole)) AS total FROM own GROUP BY 1"), 7, "total")

# Spreads of loadings, two studies side by side, and the step that reaches a target.
_query("loading_deviation", lambda s, d: D.loading_deviation(P.loadings(s, d)), _with("loading", "", "line, median(dc) AS median, quantile_cont(dc, 0.9) AS decile, stddev_pop(dc) AS deviation FROM loading GROUP BY 1"), 8, "median decile deviation")


def _two_studies(s: SparkSession, d: str) -> DataFrame:
    x = P.loadings(s, d).groupBy("snapshot", "seed", "line").agg(F.max("ac").alias("ac"), F.max("dc").alias("dc"))
    solved = x.select("snapshot", "seed").distinct().withColumn("converged", (F.month("snapshot") + F.col("seed")) % 5 > 0)
    return D.ac_against_dc(x.where("line % 3 > 0").select("snapshot", "seed", "line", F.when(F.col("seed") < 7, F.col("ac")).alias("ac")), x.where("line % 4 > 0").drop("ac"), solved)


_query("ac_against_dc", _two_studies, _with("loading", "", "snapshot, seed, line, max(ac) AS ac, max(dc) AS dc FROM loading WHERE line % 3 > 0 AND line % 4 > 0 AND seed < 7 AND (month(snapshot) + seed) % 5 > 0 GROUP BY 1, 2, 3"), 8, "ac dc")


def _target_step(s: SparkSession, d: str) -> DataFrame:
    c = _C(s, d).withColumn("mitigated_step", (F.col("component_number") * 3 - 3).cast("int"))
    curve = M.severe_curve(_S(s, d).withColumn("lost_load_share_blackout", F.round("lost_load_share_blackout", 9)), c, list(range(0, 19, 3)))
    whole = curve.where("step = 0").first()
    return M.first_within(curve, 0.5 * (whole["weight"] if whole else 0))


_query("target_step", _target_step, _x("min(step) FILTER (weight <= 0.5*(SELECT weight FROM cur WHERE step = 0)) AS first_step, min(weight) AS least FROM cur", """off AS (SELECT split_number, k::INT AS step, sum(load_share) AS o FROM los, range(0, 19, 3) t(k) WHERE component_number*3 - 3 >= 0 AND component_number*3 - 3 <= k GROUP BY 1, 2),
cur AS (SELECT t.k::INT AS step, coalesce(sum(total_weighting) FILTER (round(lost_load_share_blackout, 9) - coalesce(o, 0) > 0.8), 0)::BIGINT AS weight FROM spl CROSS JOIN range(0, 19, 3) t(k) LEFT JOIN off ON off.split_number = spl.split_number AND off.step = t.k GROUP BY 1)"""))
