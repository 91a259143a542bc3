"""Indicator vectors of splits: construction, distances in blocks, cluster statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors, at least and at most, and blocks of a table as long as these allow it.
LEAST_BLOCK, BLOCK, BLOCKS = 500, 16_384, 16
#: Rows by rows that a task compares at once.
SIDE = 1_024
#: Clusters whose counts go to every task.
LABELS = 1_024


def membership(c: DataFrame, n: int) -> DataFrame:
    """0/1 vector over nodes of each split's components."""
    s = c.groupBy("split_number").agg(F.collect_set("node_idx").alias("nodes"))
    return s.select("split_number", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains("nodes", i).cast("int")).alias("v"))


def nodal_values(c: DataFrame, n: int) -> DataFrame:
    """Vector of the greatest absolute rate at each node of a split, 0 where it has none."""
    per = c.groupBy("split_number", "node_idx").agg(F.max_by("rocof", F.struct(F.abs("rocof"), F.col("rocof"))).alias("x"))
    m = per.groupBy("split_number").agg(F.map_from_entries(F.collect_list(F.struct("node_idx", "x"))).alias("m"))
    return m.select("split_number", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("v"))


def transformed(v: Column, kind: str) -> Column:
    """Elementwise transforms of vectors by name."""
    kinds = {
        "blackout": lambda x: F.when(x > 1, 1).when(x < -1, -1).otherwise(0),
        "sign": lambda x: F.signum(x),
        "tanh": lambda x: F.tanh(x),
        "clipped": lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)),
        "below_zero": lambda x: F.least(x, F.lit(0.0)),
        "blackout_under": lambda x: F.when(x < -1, 1).otherwise(0),
        "not_zero": lambda x: (x != 0).cast("int"),
        "over_under": lambda x: F.when(x > 1, 1).when(x < -1, 2).otherwise(0),
    }
    if kind not in kinds:
        raise ValueError(f"unknown transform {kind}")
    return F.transform(v, kinds[kind])


def main_component(v: Column, by: str) -> Column:
    """1 at the nodes of the main component, by vectors of each node's load share, else 0.

    The main component has the greatest share ("largest") or the share that most nodes have
    ("most_frequent", of equally frequent ones the first in the vector).
    """
    if by == "largest":
        main = F.array_max(v)
    elif by == "most_frequent":
        main = F.array_max(F.transform(F.array_distinct(v), lambda x, i: F.struct(F.size(F.filter(v, lambda y: y == x)).alias("n"), (-i).alias("at"), x.alias("x"))))["x"]
    else:
        raise ValueError(f"unknown main component {by}")
    return F.transform(v, lambda x: (x == main).cast("int"))


def misplaced_nodes(c: DataFrame, n: int) -> DataFrame:
    """How many of n nodes are in several components of a split, and how many in none: split_number, doubled, missing. Rows only where there are any."""
    per = c.select("split_number", "component_number", "node_idx").distinct().groupBy("split_number", "node_idx").agg(F.count("*").alias("k"))
    x = per.groupBy("split_number").agg(F.count_if(F.col("k") > 1).alias("doubled"), (n - F.count("*")).alias("missing"))
    return x.where("doubled > 0 or missing > 0")


def exact_nodal_values(c: DataFrame, n: int) -> DataFrame:
    """Rates as in ``nodal_values``, but a split where a node isn't in exactly one component is refused."""
    bad = misplaced_nodes(c, n).limit(1).collect()
    if bad:
        raise ValueError(f"split {bad[0][0]}: {bad[0][1]} nodes in several components, {bad[0][2]} in none")
    return nodal_values(c, n)


def unique_vectors(x: DataFrame, key: str, v: str, w: str) -> DataFrame:
    """Distinct vectors with the smallest key, their number and summed weight."""
    return x.groupBy(v).agg(F.min(key).alias("uid"), F.count("*").alias("n"), F.sum(w).alias("weight"))


@dataclass
class Block:
    """Rows of one block by ascending key: keys, vectors and weights."""

    key: np.ndarray
    v: np.ndarray
    w: np.ndarray

    def part(self, at: int) -> Block:
        return Block(self.key[at : at + SIDE], self.v[at : at + SIDE], self.w[at : at + SIDE])


def matrix(c: pa.ChunkedArray) -> np.ndarray:
    """Arrays of one length as rows of a matrix."""
    if c.null_count or len(pc.unique(pc.list_value_length(c))) > 1:
        raise ValueError("vectors must all have the same number of positions")
    flat = pa.chunked_array([x.flatten() for x in c.chunks], c.type.value_type).to_numpy()
    return flat.reshape(len(c), -1).astype(float)


def tiled(x: DataFrame, key: str, vector: str, weight: str | None, run: Callable[[Block, Block, bool], Iterator[pa.RecordBatch]], schema: str, block: int = BLOCK) -> DataFrame:
    """What ``run`` yields for each tile, a pair of blocks of rows (in the diagonal ones the block is the same).

    Each tile is one task, which holds two blocks of ``block`` rows at most. Rows are dealt to BLOCKS blocks
    until these are full, so that what is shuffled grows with the table up to BLOCKS * ``block`` rows.
    """
    n = x.agg(F.count("*").alias("n")).first()["n"]
    blocks = max(1, min(-(-n // min(LEAST_BLOCK, block)), max(BLOCKS, -(-n // block))))
    cols = [F.col(key).cast("long").alias("i"), F.col(vector).alias("v"), *([F.col(weight).alias("w")] if weight else [])]
    v = x.select(*cols, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("t"))
    dealt = v.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("a", F.least("t", "o")).withColumn("b", F.greatest("t", "o")).drop("o")

    def tile(of: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = pa.Table.from_batches(list(batches)).sort_by("i")
        a, b = (z.as_py() for z in of)
        sides = []
        for t in (a, b):
            y = d.filter(pc.equal(d["t"], t)) if a != b else d
            if not len(y):
                return
            m = matrix(y["v"])
            sides.append(Block(y["i"].to_numpy(), m, matrix(y["w"]) if weight else m))
        yield from run(*sides, a == b)

    # Tiles are work, whatever their size: they stay apart.
    return dealt.repartition(min(blocks * (blocks + 1) // 2, 4_096), "a", "b").groupBy("a", "b").applyInArrow(tile, schema)


def squares(p: Block, q: Block, same: bool) -> Iterator[tuple[Block, Block, np.ndarray | None]]:
    """The pairs of a tile in squares, with a mask where some of them are left out (of one block each pair counts once)."""
    for r in range(0, len(p.key), SIDE):
        for s in range(r if same else 0, len(q.key), SIDE):
            x, y = p.part(r), q.part(s)
            yield x, y, x.key[:, None] < y.key[None, :] if same else None


def blocked_pairs(x: DataFrame, key: str, vector: str, weight: str | None, distance, least_key_gap: int = 1, tile: int = BLOCK, most: float | None = None, digits: int | None = None) -> DataFrame:
    """Distances of all pairs i < j, or of those up to ``most``, by tiles of the upper triangle, rounded where ``digits`` are given.

    ``distance`` takes two matrices (and two weight matrices) to a matrix. Tiles yield
    their pairs square by square.
    """

    def run(p: Block, q: Block, same: bool) -> Iterator[pa.RecordBatch]:
        for a, b, keep in squares(p, q, same):
            d = distance(a.v, b.v, a.w, b.w)
            if most is not None:
                keep = (d <= most) if keep is None else keep & (d <= most)
            i, j = np.broadcast_arrays(a.key[:, None], b.key[None, :])
            i, j, d = (z.ravel() if keep is None else z[keep] for z in (i, j, d))
            if digits is not None:  # halves upwards, as both engines do; a pair's share of this is small here
                d = np.floor(d * 10.0**digits + 0.5) / 10.0**digits
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(d, from_pandas=True)], ["i", "j", "d"])

    return tiled(x, key, vector, weight, run, "i long, j long, d double", tile)


def hamming(a: np.ndarray, b: np.ndarray, *_: np.ndarray) -> np.ndarray:
    """Share of differing entries."""
    # Counts of entries are exact in single precision.
    return sum((a == c).astype(np.float32) @ (b != c).astype(np.float32).T for c in np.unique(a)).astype(float) / a.shape[1]


def class_distance(a: np.ndarray, b: np.ndarray, *_: np.ndarray) -> np.ndarray:
    """Half the mean absolute difference."""
    return np.stack([np.abs(x - b).sum(1) for x in a]) / a.shape[1] / 2


def weighted_hamming(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One less the agreeing share of the products of weights."""
    total = u @ v.T
    agree = sum((u * (a == c)) @ (v * (b == c)).T for c in np.unique(a))
    return 1 - np.round((agree + 1e-10) / (total + 1e-10), 6)


def balanced_accuracy(classes: tuple[int, ...]):
    """The mean over all classes of one less the share of both vectors' own weights on which they agree.

    The weights of a class are each vector's own, where it has the class; agreeing
    positions count with the sum of both. Every class's share is rounded to 6 digits.
    """

    def distance(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        lost = np.zeros((len(a), len(b)))
        for c in classes:
            x, y = (a == c).astype(float), (b == c).astype(float)
            agree = (u * x) @ y.T + x @ (v * y).T
            own = (u * x).sum(1)[:, None] + (v * y).sum(1)[None, :]
            lost += 1 - np.round((agree + 1e-10) / (own + 1e-10), 6)
        return lost / len(classes)

    return distance


def balanced_overlap(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One less the mean, over non-zero and zero positions, of agreeing products of weights by summed weights.

    Equal vectors aren't at distance 0.
    """
    score = 0
    for x, y in (((a != 0).astype(float), (b != 0).astype(float)), ((a == 0).astype(float), (b == 0).astype(float))):
        score = score + ((u * x) @ (v * y).T) / ((u * x).sum(1)[:, None] + (v * y).sum(1)[None, :] + 1e-10)
    return 1 - score / 2


def cosine(a: np.ndarray, b: np.ndarray, *_: np.ndarray) -> np.ndarray:
    """Cosine distance; a zero vector is at distance 1 of every other."""
    na, nb = (np.linalg.norm(x, axis=1) for x in (a, b))
    n = na[:, None] * nb[None, :]
    return np.where(n > 0, np.clip(1 - (a @ b.T) / np.where(n > 0, n, 1), 0, 2), 1.0)


def joint(mean: Callable[[np.ndarray, np.ndarray], np.ndarray], first, second):
    """A mean of the first distance, of vectors, and the second, of their weights, taken pair by pair in the same tile."""
    return lambda a, b, u, v: mean(first(a, b), second(u, v))


def geometric_similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One less the geometric mean of the similarities."""
    return 1 - np.sqrt(np.maximum((1 - x) * (1 - y), 0))


def root_of_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Square root of the product."""
    return np.sqrt(np.maximum(x * y, 0))


def harmonic_mean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Harmonic mean; of two zeros it is 0."""
    return 2 * x * y / (x + y + 1e-10)


def combined(pairs: list[DataFrame]) -> DataFrame:
    """Geometric mean of similarities of pair tables (i, j, d)."""
    out = None
    for k, p in enumerate(pairs):
        p = p.withColumnRenamed("d", f"d{k}")
        out = p if out is None else out.join(p, ["i", "j"])
    similar = 1 - F.col("d0")
    for k in range(1, len(pairs)):
        similar = similar * (1 - F.col(f"d{k}"))
    return out.select("i", "j", (1 - F.pow(F.greatest(similar, F.lit(0.0)), F.lit(1.0 / len(pairs)))).alias("d"))


def product_root(p: DataFrame, q: DataFrame) -> DataFrame:
    """Square root of the product of the distances of two pair tables."""
    return _two(p, q, F.sqrt(F.col("d0") * F.col("d1")))


def harmonic(p: DataFrame, q: DataFrame) -> DataFrame:
    """Harmonic mean of the distances of two pair tables."""
    return _two(p, q, 2 * F.col("d0") * F.col("d1") / (F.col("d0") + F.col("d1") + 1e-10))


def _two(p: DataFrame, q: DataFrame, d: Column) -> DataFrame:
    return p.withColumnRenamed("d", "d0").join(q.withColumnRenamed("d", "d1"), ["i", "j"]).select("i", "j", d.alias("d"))


def scalar_metrics(p: DataFrame) -> DataFrame:
    """Metrics of single pairs, from arrays: i, j, x, y (classes) and u, v (weights of at least 0).

    product: summed products of weights where the classes differ; overlap and
    multiclass: one less the mean over two classes (non-zero or not), or over all
    classes of the pair, of agreeing weights by both vectors' own; accuracy: one
    less the agreeing share of the products; plain: overlap with all weights 1.
    Pairs of one common class are at distance 0.
    """
    z = F.arrays_zip("x", "y", "u", "v")
    total = lambda f: F.aggregate(z, F.lit(0.0), lambda s, e: s + f(e))
    when = lambda c, w: F.when(c, w).otherwise(0.0)

    def share(a, weights):  # of the class that a function of an entry tells
        u, v = weights
        agree = total(lambda e: when(a(e["x"]) & a(e["y"]), u(e) + v(e)))
        return agree / total(lambda e: when(a(e["x"]), u(e)) + when(a(e["y"]), v(e)))

    given, ones = (lambda e: e["u"], lambda e: e["v"]), (lambda e: F.lit(1.0), lambda e: F.lit(1.0))
    two = lambda w: 1 - (share(lambda c: c != 0, w) + share(lambda c: c == 0, w)) / 2
    classes = F.array_distinct(F.concat("x", "y"))
    alone = F.size(classes) == 1
    shares = F.transform(classes, lambda c: share(lambda x: x == c, given))
    return p.select(
        "i", "j", total(lambda e: when(e["x"] != e["y"], e["u"] * e["v"])).alias("product"),
        F.when(alone, 0.0).otherwise(two(given)).alias("overlap"), F.when(alone, 0.0).otherwise(two(ones)).alias("plain"),
        (1 - F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) / F.size(classes)).alias("multiclass"),
        (1 - total(lambda e: when(e["x"] == e["y"], e["u"] * e["v"])) / total(lambda e: e["u"] * e["v"])).alias("accuracy"),
    )


def silhouette(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Silhouette of each row from pair distances: i, label, silhouette; alone in a cluster it is 0."""
    i, j = (labels.select(F.col("key").alias(c), F.col("label").alias(f"l{c}")) for c in "ij")
    x = pairs.join(i, "i").join(j, "j")
    sides = F.explode(F.array(F.struct(F.col("i").alias("k"), F.col("li").alias("own"), F.col("lj").alias("other")), F.struct(F.col("j").alias("k"), F.col("lj").alias("own"), F.col("li").alias("other"))))
    # Sums of a row by the others' label; they are formed before anything is shuffled by row.
    m = x.select("d", sides.alias("s")).groupBy("s.k", "s.own", "s.other").agg(F.avg("d").alias("d"))
    s = m.groupBy(F.col("k").alias("i"), F.col("own").alias("label")).agg(F.min(F.when(F.col("own") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("own") != F.col("other"), F.col("d"))).alias("b"))
    return s.select("i", "label", _silhouette())


def _silhouette() -> Column:
    """From the mean distances to the own cluster (a) and the nearest other one (b)."""
    return F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette")


def hamming_silhouette(x: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Silhouettes as in ``silhouette``, of distances that are shares of differing entries: i, label, silhouette.

    A row's summed distance to a cluster follows from the counts of each entry at each
    position in it, so that no pair is looked at. The counts go to every task; of over LABELS clusters
    the pairs are taken instead.
    """
    y = x.select(F.col(key).cast("long").alias("i"), F.col(label).alias("label"), F.col(vector).alias("v"))
    n, n_labels = y.agg(F.count("*"), F.count_distinct("label")).first()
    if n_labels > LABELS:
        return silhouette(blocked_pairs(y, "i", "v", None, hamming), y.select(F.col("i").alias("key"), "label"))
    labelled = y.where("label is not null")
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n")).toPandas()  # a row for each cluster
    seen = labelled.select("label", F.posexplode("v").alias("pos", "entry")).groupBy("label", "pos", "entry").agg(F.count("*").alias("n")).toPandas()  # and for each of its entries at a position
    labels, size = pd.Index(sizes["label"]), sizes["n"].to_numpy()
    entries, width = np.unique(seen["entry"].to_numpy(float)), int(seen["pos"].max()) + 1 if len(seen) else 0
    counts = np.zeros((len(entries), width, len(labels)))
    counts[np.searchsorted(entries, seen["entry"].to_numpy(float)), seen["pos"], labels.get_indexer(seen["label"])] = seen["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            v = matrix(pa.chunked_array([b.column("v")]))
            own = labels.get_indexer(b.column("label").to_pandas())
            far = (size * v.shape[1] - sum(((v == c) @ k for c, k in zip(entries, counts, strict=True)), np.zeros((len(v), len(labels))))) / max(1, v.shape[1])
            near = np.full((2, len(v)), np.nan)
            rows = np.flatnonzero(own >= 0)
            more = rows[size[own[rows]] > 1]
            near[0, more] = far[more, own[more]] / (size[own[more]] - 1)
            if len(labels) > 1:
                mean = far / size
                mean[rows, own[rows]] = np.inf
                near[1, rows] = mean[rows].min(1)
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("label"), *(pa.array(z, from_pandas=True) for z in near)], ["i", "label", "a", "b"])

    # A single row has no distances.
    return y.where(F.lit(n > 1)).mapInArrow(run, f"i long, label {dict(y.dtypes)['label']}, a double, b double").select("i", "label", _silhouette())


def centroids(x: DataFrame, label: str, v: str, w: str) -> DataFrame:
    """Share of the weight of each class at each position, by label."""
    e = x.select(label, w, F.posexplode(v).alias("pos", "class"))
    g = e.groupBy(label, "pos", "class").agg(F.sum(w).alias("weight"))
    return g.withColumn("probability", F.col("weight") / F.sum("weight").over(Window.partitionBy(label, "pos"))).drop("weight")


def cluster_stats(x: DataFrame, label: str, value: Column, w: str) -> DataFrame:
    """Weighted value, its share of all, and weight of each label."""
    g = x.groupBy(label).agg(F.sum(value * F.col(w)).alias("value"), F.sum(w).alias("weight"), F.count("*").alias("n"))
    return g.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy()))


def _on_grid(v: pd.Series, n: int) -> np.ndarray:
    """Vectors as a matrix; one that doesn't have a position for each node is refused."""
    if set(v.map(len)) - {n}:
        raise ValueError(f"vectors must have {n} positions, one for each node")
    return np.stack(v.to_numpy()) if len(v) else np.zeros((0, n))


def boundary(x: DataFrame, key: str, v: str, edges: DataFrame, alpha: float = 0.5, steps: int = 3, signed: bool = True) -> DataFrame:
    """Boundary of classes on a grid, smoothed by steps of a lazy random walk: key, boundary (its size) and field.

    Each step keeps 1 - alpha of a node's value and takes alpha of its neighbours'
    mean; one less the field weighs nodes far from boundaries. Vectors have one
    position for each node. With ``signed`` two cut edges of opposite orientation
    at a node cancel. The grid is one small table and goes to
    every task.
    """
    e = edges.select("u", "v").orderBy("u", "v").toPandas().to_numpy()  # one grid's edges
    n = int(e.max()) + 1
    inc = np.zeros((n, len(e)))
    inc[e[:, 0], np.arange(len(e))], inc[e[:, 1], np.arange(len(e))] = 1, -1
    adj = (np.abs(inc) @ np.abs(inc).T > 0) & ~np.eye(n, dtype=bool)
    walk = adj / np.maximum(1, adj.sum(1, keepdims=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            m = _on_grid(d["v"], n).astype(float)
            cut = (m @ inc != 0).astype(float)
            b = ((cut @ inc.T != 0) if signed else (cut @ np.abs(inc).T > 0)).astype(float)
            s = b.copy()
            for _ in range(steps):
                s = (1 - alpha) * s + alpha * s @ walk.T
            yield pd.DataFrame({"key": d["key"], "boundary": b.sum(1), "field": list(np.clip(s, 0, 1))})

    return x.select(F.col(key).alias("key"), F.col(v).alias("v")).mapInPandas(run, "key long, boundary double, field array<double>")


def _walks(adj: np.ndarray, depth: int, decay: float) -> np.ndarray:
    """Share of the walks of each length that end at a node, times length**-decay, summed over lengths."""
    weight, power = np.zeros(adj.shape), np.eye(len(adj))
    for d in range(1, depth + 1):
        power = power @ adj
        weight += power / np.maximum(power.sum(0, keepdims=True), 1e-12) * float(d) ** -decay
    return weight


def _adjacency(edges: DataFrame) -> np.ndarray:
    e = edges.select("u", "v").toPandas().to_numpy()  # one grid's edges
    n = int(e.max()) + 1
    adj = np.zeros((n, n))
    adj[e[:, 0], e[:, 1]] = adj[e[:, 1], e[:, 0]] = 1
    return adj


def homogeneity(x: DataFrame, key: str, v: str, edges: DataFrame, classes: tuple[int, ...], depth: int = 10, decay: float = 1.5, measure: str = "entropy") -> DataFrame:
    """How alike the classes around each node are: key, homogeneity as an array over nodes.

    Vectors have one position for each node; ``classes`` are those of all vectors, two at least.
    A node at d steps weighs by its share of the walks of that length times d**-decay;
    the measure is one less the entropy by the logarithm of the number of classes, or
    one less the Gini impurity. Values below 0 by less than 1e-6 are 0.
    """
    if measure not in ("entropy", "gini"):
        raise ValueError(f"unknown measure {measure}")
    if len(classes) < 2:
        raise ValueError("two classes at least are needed")
    adj = _adjacency(edges)
    n, weight = len(adj), _walks(adj, depth, decay)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = _on_grid(b["v"], n)
            p = np.stack([(m == c).astype(float) @ weight for c in classes])
            p = p / np.maximum(p.sum(0), 1e-300)
            mixed = -(p * np.log(p + 1e-10)).sum(0) / np.log(len(classes)) if measure == "entropy" else 1 - (p**2).sum(0)
            out = 1 - mixed
            if out.size and out.min() <= -1e-6:
                raise ValueError(f"homogeneity of {out.min()}")
            yield pd.DataFrame({"key": b["key"], "homogeneity": list(np.clip(out, 0, 1))})

    return x.select(F.col(key).alias("key"), F.col(v).alias("v")).mapInPandas(run, "key long, homogeneity array<double>")


def typed_katz(x: DataFrame, key: str, v: str, edges: DataFrame, depth: int = 10, decay: float = 1.5) -> DataFrame:
    """How one-sided the surroundings of each node are: key, katz (an array over nodes, 0 for an even mix).

    Classes are 0 and 1, taken as -1 and 1, or -1 and 1; nodes weigh as in ``homogeneity``.
    """
    adj = _adjacency(edges)
    n, weight = len(adj), _walks(adj, depth, decay)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = _on_grid(b["v"], n).astype(float)
            if not np.isin(m, (-1, 0, 1)).all() or ((m == 0).any(1) & (m == -1).any(1)).any():
                raise ValueError("classes must be 0 and 1, or -1 and 1")
            signed = np.where((m == -1).any(1, keepdims=True), m, 2 * m - 1)
            yield pd.DataFrame({"key": b["key"], "katz": list(np.abs(signed @ weight))})

    return x.select(F.col(key).alias("key"), F.col(v).alias("v")).mapInPandas(run, "key long, katz array<double>")


def typed_katz_walks(x: DataFrame, key: str, v: str, edges: DataFrame, depth: int = 10, decay: float = 0.1) -> DataFrame:
    """Walks from each node to nodes of class 1 less those to the other class, each of length d by decay**d: key, katz (signed, an array over nodes).

    Vectors hold two classes, both of 0 and 1 or both of -1 and 1; others are refused. The grid is one small table and goes to every task.
    """
    adj = _adjacency(edges)
    n, weight, power = len(adj), np.zeros(adj.shape), np.eye(len(adj))
    for d in range(1, depth + 1):
        power = power @ adj
        weight += power * decay**d

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = _on_grid(b["v"], n).astype(float)
            low = m.min(1, keepdims=True)
            if not (np.isin(low, (-1, 0)).all() and ((m == 1) | (m == low)).all() and (m == 1).any(1).all()):
                raise ValueError("classes must be 0 and 1, or -1 and 1")
            yield pd.DataFrame({"key": b["key"], "katz": list(np.where(m == 1, 1.0, -1.0) @ weight)})

    return x.select(F.col(key).alias("key"), F.col(v).alias("v")).mapInPandas(run, "key long, katz array<double>")
