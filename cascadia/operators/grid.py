"""Grid operators: circuits, contingencies, bridges, components, power flow, cascades.

Tables of lines and contingencies are DataFrames; the one small grid goes to every
task, which works through its contingencies or snapshots with dense matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a block whose pairs are formed in one task; below what a sort-merge join keeps in memory for a key.
PAIRED = 2_000

#: What the number of parallel circuits drops to when one is lost, for security-constrained grids.
STEP_DOWN = [
    (0.28947368, 0.0), (0.57894737, 0.28947368), (0.59210526, 0.0), (0.86842105, 0.57894737), (0.88157895, 0.28947368), (1.0, 0.0),
    (1.15789474, 0.86842105), (1.18421053, 0.59210526), (1.28947368, 0.28947368), (1.44736842, 1.15789474), (1.47368421, 0.88157895),
    (1.57894737, 0.57894737), (1.59210526, 0.59210526), (1.73684211, 1.44736842), (1.77631579, 1.18421053), (1.86842105, 0.86842105),
    (2.0, 1.0), (2.02631579, 1.73684211), (2.06578947, 1.47368421), (2.15789474, 1.15789474), (2.18421053, 1.18421053),
    (2.28947368, 1.28947368), (2.31578947, 2.02631579), (2.36842105, 1.77631579), (2.44736842, 1.44736842), (2.57894737, 1.57894737),
    (2.59210526, 1.59210526), (2.65789474, 2.06578947), (2.73684211, 1.73684211), (2.77631579, 1.77631579), (2.86842105, 1.86842105),
]
#: The same for grids without security constraints.
STEP_DOWN_PLAIN = [
    (0.33518006, 0.0), (0.67036011, 0.33518006), (0.67590027, 0.0), (1.0, 0.0), (1.00554017, 0.67036011), (1.01108033, 0.67590027),
    (1.33518006, 1.0), (1.34072022, 1.00554017), (1.34626039, 1.01108033), (1.67036011, 1.33518006), (1.67590028, 1.34072022),
    (1.68144040, 1.34626039), (2.0, 1.0), (2.00554017, 1.00554017), (2.01108033, 1.67590028), (2.01662050, 1.68144040),
    (2.33518006, 1.33518006), (2.34072022, 1.34072022), (2.34626039, 2.01108033), (2.67036011, 1.67036011), (2.67590028, 1.67590028),
    (2.68144044, 2.34626039),
]


def lost_sizes(x: float, steps: list[tuple[float, float]] = STEP_DOWN) -> list[float]:
    """The sizes of circuits lost one after the other, from x parallel ones to none.

    From 3 on a loss takes one; below, the table says what is left.
    """
    out = []
    while x > 1e-8:
        left = x - 1 if x >= 3 else next((b for a, b in steps if abs(x - a) <= 1e-8 + 1e-5 * abs(a)), None)
        if left is None:
            raise KeyError(f"no entry for {x} parallel circuits")
        out.append(round(x - left, 7))
        x = left
    return out


def circuits(lines: DataFrame, steps: list[tuple[float, float]] = STEP_DOWN) -> DataFrame:
    """How many circuits of each size a line has: line, size, n, by losing them one after the other.

    A line whose number of circuits isn't in the table has no rows.
    """
    x = F.col("num_parallel")
    ones = F.when(x >= 3, F.floor(x - 3).cast("int") + 1).otherwise(0)
    rest = x - ones
    known = F.when(F.abs(rest) <= 1e-8, F.array().cast("array<double>"))
    for a, _ in steps:
        known = known.when(F.abs(rest - a) <= 1e-8 + 1e-5 * abs(a), F.array(*map(F.lit, lost_sizes(a, steps))))
    sizes = lines.select("line", F.explode(F.concat(F.array_repeat(F.lit(1.0), ones), known)).alias("size"))
    return sizes.groupBy("line", "size").agg(F.count("*").alias("n"))


def single_contingencies(counts: DataFrame, bridges: DataFrame) -> DataFrame:
    """One circuit of one size of one line, weighted by their number; bridges are left out."""
    return counts.join(bridges, "line", "left_anti").select("line", "size", F.col("n").alias("weight"))


def single_lines(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines (line, corridor) that alone hold two parts of the grid together: no other line of a corridor that is a bridge."""
    corridors = bridges(edges, edges.select(F.col("edge_idx").cast("long").alias("id"), "edge_idx")).where("bridge").select(F.col("edge_idx").alias("corridor"))
    alone = lines.groupBy("corridor").agg(F.min("line").alias("line"), F.count("*").alias("n")).where("n = 1")
    return alone.join(corridors, "corridor", "left_semi").select("line")


def double_contingencies(singles: DataFrame, blocks: int | None = None) -> DataFrame:
    """All pairs of circuits: n (n - 1) / 2 of one kind, else the product of their numbers.

    Lines are dealt to blocks by hash, of PAIRED lines if no number is given; each pair of blocks meets under a key of
    its own, the first on the left and the second on the right, so that each pair of lines is looked at once.
    """
    singles = singles.select("line", "size", "weight").where("line is not null and size is not null")
    if blocks is None:
        blocks = max(8, -(-singles.count() // PAIRED))
    of = F.pmod(F.xxhash64("line", "size"), F.lit(blocks)).cast("int")
    tiles = min(blocks * (blocks + 1) // 2, 4_096)
    x = singles.withColumn("block", of)
    a = x.select("line", "size", "weight", F.col("block").alias("t0"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("t1")).repartition(tiles, "t0", "t1").alias("a")
    b = x.select("line", "size", "weight", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("t0"), F.col("block").alias("t1")).repartition(tiles, "t0", "t1").alias("b")
    after = (F.col("b.line") > F.col("a.line")) | ((F.col("b.line") == F.col("a.line")) & (F.col("b.size") >= F.col("a.size")))
    same = (F.col("a.line") == F.col("b.line")) & (F.col("a.size") == F.col("b.size"))
    w = F.when(same, F.col("a.weight") * (F.col("a.weight") - 1) / 2).otherwise(F.col("a.weight") * F.col("b.weight"))
    pairs = a.join(b, (F.col("a.t0") == F.col("b.t0")) & (F.col("a.t1") == F.col("b.t1")) & ((F.col("a.t0") != F.col("a.t1")) | after))
    one, other = ([F.when(after, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")) for c in ("line", "size")] for x, y in ("ab", "ba"))
    return pairs.select(one[0].alias("line_0"), one[1].alias("size_0"), other[0].alias("line_1"), other[1].alias("size_1"), w.alias("weight")).where("weight > 0")


def merge_parallel(lines: DataFrame) -> DataFrame:
    """Fold the parts of an outage line into it: sums by name without the suffix."""
    return lines.groupBy(F.regexp_replace("name", "_outage$", "").alias("base")).agg(F.sum("num_parallel").alias("num_parallel"), F.sum("s_nom").alias("s_nom"), F.sum("p0").alias("p0"), F.count("*").alias("parts"))


def bus_types(capacity: DataFrame, buses: DataFrame, share: float = 0.3) -> DataFrame:
    """Slack, PV and PQ buses by rank of conventional capacity: bus, p_nom, kind.

    ``capacity`` has bus and p_nom of units, summed here; only buses with some can
    be more than PQ. The greatest is slack, the next ``share`` of all buses are PV,
    as far as there are any; ties go to the smaller bus.
    """
    cap = capacity.groupBy("bus").agg(F.round(F.sum("p_nom"), 6).alias("p_nom"))
    n = F.count("*").over(Window.partitionBy())
    x = buses.select("bus").join(cap, "bus", "left").fillna(0.0, ["p_nom"])
    # One row for each bus of one grid.
    x = x.select("bus", "p_nom", F.row_number().over(Window.orderBy(F.desc("p_nom"), "bus")).alias("r"), n.alias("n"), F.count_if(F.col("p_nom") > 0).over(Window.partitionBy()).alias("able"))
    pv = F.least(F.bround(F.col("n") * share), F.col("able") - 1)
    return x.select("bus", "p_nom", F.when(F.col("p_nom") <= 0, "PQ").when(F.col("r") == 1, "Slack").when(F.col("r") <= 1 + pv, "PV").otherwise("PQ").alias("kind"))


def power_factors(types: DataFrame, middle: float = 0.95, width: float = 0.05, seed: int = 0) -> DataFrame:
    """A power factor for each PQ bus, even over the range and clipped to 0 to 1, and the reactive share of its load.

    The draw is a hash of bus and seed, so that it is the same at every run; other
    buses have no factor and share 0.
    """
    draw = F.pmod(F.xxhash64("bus", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    factor = F.when(F.col("kind") == "PQ", F.greatest(F.lit(0.0), F.least(F.lit(1.0), middle - width / 2 + width * draw)))
    return types.select("bus", "kind", factor.alias("factor")).withColumn("tangent", F.coalesce(F.tan(F.acos("factor")), F.lit(0.0)))


#: What a flow must exceed its limit by, in parts of it, for the edge to fail.
EPSILON = 1e-4


class Grid:
    """A small grid as arrays: ends, susceptances, limits."""

    def __init__(self, edges: pd.DataFrame):
        e = edges.sort_values("edge_idx")
        self.u, self.v = e["u"].to_numpy(int), e["v"].to_numpy(int)
        self.b = e["weight"].to_numpy(float)
        self.limit, self.par = e["s_nom"].to_numpy(float), e["num_parallel"].to_numpy(float)
        self.n = int(max(self.u.max(), self.v.max())) + 1

    def labels(self, on: np.ndarray) -> np.ndarray:
        """Component of each node, the smallest node in it, over the edges that are on."""
        label = np.arange(self.n)
        u, v = self.u[on], self.v[on]
        while True:
            new = label.copy()
            np.minimum.at(new, u, label[v])
            np.minimum.at(new, v, label[u])
            new = new[new]
            if (new == label).all():
                return label
            label = new

    def flow(self, p: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Flows of injections p (node, case) with the first node as reference."""
        inc = np.zeros((self.n, len(self.u)))
        inc[self.u, np.arange(len(self.u))], inc[self.v, np.arange(len(self.u))] = 1, -1
        lap = (inc * b) @ inc.T
        theta = np.zeros_like(p)
        theta[1:] = np.linalg.solve(lap[1:, 1:], p[1:])
        return b[:, None] * (inc.T @ theta)

    def cascade(self, p: np.ndarray, removed: list[tuple[int, float]], scale: float = 1.0, most: int | None = None) -> tuple[list[int], bool, int]:
        """(failed edges, whether the grid split, steps) after circuits are removed.

        A removal lowers an edge's susceptance and limit in proportion. Then, step
        by step, connectivity is tested first, and overloaded edges fail, until none
        does or the grid splits (or for ``most`` steps). A removal of more than an edge
        has is refused.
        """
        b, limit, par = self.b.copy(), self.limit * scale, self.par.copy()
        for e, size in removed:
            if size > par[e] + 1e-6:
                raise ValueError(f"edge {e} has {par[e]} circuits, not {size}")
            left = max(0.0, par[e] - size)
            left = 0.0 if left < 1e-6 else left
            f = left / par[e] if par[e] > 0 else 0.0
            b[e], limit[e], par[e] = b[e] * f, limit[e] * f, left
        failed = [e for e in range(len(b)) if b[e] == 0]
        for step in range(len(b) + 1 if most is None else most):  # each step but the last loses an edge
            if len(np.unique(self.labels(b > 0))) > 1:
                return failed, True, step
            over = np.flatnonzero((np.abs(self.flow(p[:, None], b)[:, 0]) > limit * (1 + EPSILON)) & (b > 0))
            if not len(over):
                return failed, False, step
            failed += over.tolist()
            b[over] = 0
        return failed, False, step + 1


def bridges(edges: DataFrame, removals: DataFrame) -> DataFrame:
    """For each row of removals (id, edge_idx): how many components are left, and whether the edge is a bridge."""
    known = edges.sparkSession.sparkContext.broadcast(Grid(edges.toPandas()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = known.value
        cache: dict[int, int] = {}
        for d in batches:
            for e in d["edge_idx"].unique():
                if e not in cache:
                    cache[e] = len(np.unique(grid.labels(np.arange(len(grid.u)) != e)))
            n = d["edge_idx"].map(cache)
            yield pd.DataFrame({"id": d["id"], "edge_idx": d["edge_idx"], "n_components": n, "bridge": n > 1})

    return removals.select("id", F.col("edge_idx").cast("int")).mapInPandas(run, "id long, edge_idx int, n_components long, bridge boolean")


def components_without(edges: DataFrame, removals: DataFrame) -> DataFrame:
    """Components of the grid without some edges, for each row (id, gone array<int>): id, component, n_nodes."""
    known = edges.sparkSession.sparkContext.broadcast(Grid(edges.toPandas()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = known.value
        for d in batches:
            out = []
            for i, gone in zip(d["id"], d["gone"], strict=True):
                on = np.ones(len(grid.u), bool)
                on[np.asarray(gone, int)] = False
                label, n = np.unique(grid.labels(on), return_counts=True)
                out += [(i, int(a), int(b)) for a, b in zip(label, n, strict=True)]
            yield pd.DataFrame(out, columns=["id", "component", "n_nodes"])

    return removals.select("id", "gone").mapInPandas(run, "id long, component long, n_nodes long")


def dc_flows(edges: DataFrame, injection: DataFrame) -> DataFrame:
    """DC power flow of each snapshot: snapshot, edge_idx, flow, loading.

    Flows are linear in the injections: the grid's factors are found once on the
    driver and go to every task, which multiplies.
    """
    grid = Grid(edges.toPandas())
    factors = edges.sparkSession.sparkContext.broadcast((grid.flow(np.eye(grid.n), grid.b), grid.limit))
    p = injection.groupBy("snapshot").agg(F.array_sort(F.collect_list(F.struct("node_idx", "p0"))).alias("x")).select("snapshot", F.col("x.p0").alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_node, limit = factors.value
        for d in batches:
            if not len(d):
                continue
            f = by_node @ np.stack(d["p"].to_numpy()).T.astype(float)
            m = len(limit)
            yield pd.DataFrame({"snapshot": np.repeat(d["snapshot"].to_numpy(), m), "edge_idx": np.tile(np.arange(m), len(d)), "flow": f.T.ravel(), "loading": (np.abs(f) / limit[:, None]).T.ravel()})

    return p.mapInPandas(run, "snapshot timestamp_ntz, edge_idx int, flow double, loading double")


def outage_factors(edges: DataFrame) -> DataFrame:
    """Share of an edge's flow that each other edge takes over when it goes out: edge_idx, outage, share.

    One factorisation of the grid gives all of them. The share is null where the outage
    splits the grid; the edge itself has -1. The table has the square of the grid's edges, whatever the snapshots.
    """
    e = edges.toPandas()
    grid, known = Grid(e), np.sort(e["edge_idx"].to_numpy())
    m = len(known)
    ends = np.zeros((grid.n, m))
    ends[grid.u, np.arange(m)], ends[grid.v, np.arange(m)] = 1, -1
    by = grid.flow(ends, grid.b)  # flows of a unit sent from one end of each edge to the other
    own = 1 - np.diag(by)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(own > 1e-9, by / own, np.nan)
    share[np.arange(m), np.arange(m)] = np.where(own > 1e-9, -1.0, np.nan)
    l, k = np.meshgrid(known, known, indexing="ij")
    rows = pd.DataFrame({"edge_idx": l.ravel().astype("int32"), "outage": k.ravel().astype("int32"), "share": share.ravel()})
    out = edges.sparkSession.createDataFrame(rows, "edge_idx int, outage int, share double")
    return out.withColumn("share", F.when(F.isnan("share"), None).otherwise(F.col("share")))


def outage_flows(flows: DataFrame, factors: DataFrame) -> DataFrame:
    """Flows after each single outage: snapshot, outage, edge_idx, flow, null where the outage splits the grid.

    A snapshot's flows go along with each of them, so that one join with the factors does.
    """
    all_of = flows.groupBy("snapshot").agg(F.map_from_entries(F.collect_list(F.struct("edge_idx", "flow"))).alias("by"))
    each = all_of.select("snapshot", "by", F.explode("by").alias("edge_idx", "before")).join(factors, "edge_idx")
    return each.select("snapshot", "outage", "edge_idx", (F.col("before") + F.col("share") * F.element_at("by", F.col("outage"))).alias("flow"))


def n1_check(edges: DataFrame, injection: DataFrame, scale: float) -> DataFrame:
    """The loss of each edge at each snapshot: snapshot, edge_idx, n_failed, did_split, secure.

    ``n_failed`` counts the edge itself and those that its flow then overloads (limits are
    ``scale`` times nominal). Secure: nothing fails besides it, and the grid holds together.
    Flows after outages come from factors; no grid is solved again.
    """
    after = outage_flows(dc_flows(edges, injection), outage_factors(edges))
    limits = F.broadcast(edges.select("edge_idx", (F.col("s_nom") * scale * (1 + EPSILON)).alias("limit")))
    over = (F.col("edge_idx") != F.col("outage")) & (F.abs("flow") > F.col("limit"))
    x = after.join(limits, "edge_idx").groupBy("snapshot", F.col("outage").alias("edge_idx")).agg((1 + F.count_if(over)).cast("int").alias("n_failed"), (F.count("flow") == 0).alias("did_split"))
    return x.select("*", ((F.col("n_failed") <= 1) & ~F.col("did_split")).alias("secure"))


def cascades(edges: DataFrame, injection: DataFrame, contingencies: DataFrame, scale: float) -> DataFrame:
    """Cascades of every contingency (line_0, size_0, line_1, size_1, weight) at every snapshot: failed edges, split or not, steps.

    A contingency removes one circuit of each of its sizes; limits are ``scale``
    times nominal, for injections as they come.
    """
    spark = edges.sparkSession
    known = spark.sparkContext.broadcast(Grid(edges.toPandas()))
    p = injection.groupBy("snapshot").agg(F.array_sort(F.collect_list(F.struct("node_idx", "p0"))).alias("x")).select("snapshot", F.col("x.p0").alias("p"))
    names = ["line_0", "size_0", "line_1", "size_1", "weight"]
    work = contingencies.select(names).repartition(4 * spark.sparkContext.defaultParallelism, "line_0", "size_0", "line_1", "size_1").crossJoin(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = known.value
        for d in batches:
            out = []
            for s, e0, m0, e1, m1, w, x in zip(d["snapshot"], *(d[c] for c in names), d["p"], strict=True):
                failed, split, steps = grid.cascade(np.asarray(x, float), [(e0, m0), (e1, m1)], scale)
                out.append((s, e0, m0, e1, m1, w, sorted(failed), split, steps))
            yield pd.DataFrame(out, columns=["snapshot", *names, "failed_edges", "did_split", "steps"])

    return work.mapInPandas(run, "snapshot timestamp_ntz, line_0 int, size_0 double, line_1 int, size_1 double, weight double, failed_edges array<int>, did_split boolean, steps int")


def nodal_injection(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """Injection of each node from edge flows: plus at the first end, minus at the second."""
    f = flows.join(edges.select("edge_idx", "u", "v"), "edge_idx").select("snapshot", F.explode(F.array(F.struct(F.col("u").alias("node_idx"), F.col("flow").alias("x")), F.struct(F.col("v").alias("node_idx"), (-F.col("flow")).alias("x")))).alias("e"))
    return f.groupBy("snapshot", "e.node_idx").agg(F.sum("e.x").alias("p0"))
