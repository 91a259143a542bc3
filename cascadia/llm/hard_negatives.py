"""Hard negatives by cover trees over norm-augmented vectors.

Every vector gets one more component that makes all norms equal, so that the inner
product with a query is the cosine of an angle on one sphere, and a ball of vectors
around a centre bounds it from both sides. The top level of the tree is a net of
pivots, whose cells are dealt to shards; a shard's own levels are nested nets with
radii that halve, each node with the greatest distance to a vector below it.

Anchors visit only cells whose bounds meet what they look for. In a shard they go down level by
level, leave out nodes whose bounds lie outside all their windows, and verify the
leaves best first by exact integer products, until no leaf can better what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, saved, small_batches, table

#: Rows of a shard and anchors of one visit to it, about.
SHARD = 4096
#: Rows that the pivots are chosen from at most, those with the smallest hashes, and the number of pivots at most.
SAMPLE, PIVOTS = 2048, 512
#: Rows of a leaf, about.
LEAF = 16
#: Components are taken as at most this in absolute value, so that products of thousands fit a long.
MOST = 1 << 26
#: Beyond every score.
OPEN = 1 << 80
#: Slack of bounds against rounding, as a share of the greatest product.
SLACK = 1e-9


def angles(x: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x, -1, 1))


class Sphere:
    """Rows as unit vectors with the component that makes all norms equal."""

    def __init__(self, radius: float):
        self.radius = max(radius, 1.0)

    def rows(self, g: np.ndarray) -> np.ndarray:
        x = g / self.radius
        return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]), 1)

    def bounds(self, q: np.ndarray, centres: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with rows within the angle ``reach`` of each centre."""
        norm = np.linalg.norm(q, axis=1)
        at = angles((q / np.maximum(norm, 1e-300)[:, None]) @ centres[:, :-1].T)
        scale, slack = (norm * self.radius)[:, None], SLACK * norm.max(initial=0) * self.radius + 1e-6
        return scale * np.cos(np.minimum(np.pi, at + reach)) - slack, scale * np.cos(np.maximum(0, at - reach)) + slack


def net(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, their angle from those before, nearest centre of each row): each next centre is the row farthest from all."""
    centres, apart = [0], [np.pi]
    near, far = np.zeros(len(x), np.int64), angles(x @ x[0])
    far[0] = 0
    while len(centres) < most:
        k = int(far.argmax())
        if far[k] <= 1e-7:
            break
        centres.append(k)
        apart.append(float(far[k]))
        d = angles(x @ x[k])
        d[k] = 0
        less = d < far
        near[less], far[less] = len(centres) - 1, d[less]
    return np.array(centres), np.array(apart), near


class CoverTree:
    """Nested nets of a shard's rows; level l has the centres that are further apart than the l-th halved radius."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, g: np.ndarray, sphere: Sphere):
        order = np.argsort(ids)
        self.ids, self.label, self.g, self.sphere = ids[order], label[order], g[order], sphere
        x = sphere.rows(self.g.astype(float))
        centres, apart, near = net(x, max(1, len(x) // LEAF))
        sizes, radius = [1], apart[1] if len(apart) > 1 else 0.0
        while sizes[-1] < len(centres):
            radius /= 2
            sizes.append(max(sizes[-1] + 1, int((apart > radius).sum())))
        sizes[-1] = len(centres)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        node = near  # the node of each row on the level at hand, from the leaves up
        for level in range(len(sizes) - 1, -1, -1):
            own = centres[: sizes[level]]
            reach = np.zeros(len(own))
            np.maximum.at(reach, node, angles((x * x[own[node]]).sum(1)))
            parent = np.zeros(len(own), np.int64)
            if level:
                above = centres[: sizes[level - 1]]
                parent = angles(x[own] @ x[above].T).argmin(1)
                parent[: len(above)] = np.arange(len(above))
            self.levels.append((x[own], reach + 1e-7, parent))
            node = parent[node]
        self.levels.reverse()
        by = np.argsort(near, kind="stable")
        self.leaves = np.split(by, np.searchsorted(near[by], np.arange(1, len(centres))))

    def search(self, q: np.ndarray, label: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """(query, window, id, score) of the k greatest rows, ties by id, within each window [lo, hi] of each query.

        ``same``: rows of the query's label, else of any other. Windows are whole numbers of Python.
        """
        n, width = lo.shape
        low, high = lo.min(1).astype(float), hi.max(1).astype(float)
        live = np.ones((n, 1), bool)
        for centres, reach, parent in self.levels:
            least, greatest = self.sphere.bounds(q.astype(float), centres, reach)
            live = live[:, parent] & (greatest >= low[:, None]) & (least <= high[:, None])
        size = len(self.ids)
        exact = max(1, np.abs(q).max(initial=0)) * max(1, np.abs(self.g).max(initial=0)) * float(q.shape[1]) * (size + 1) < 2**52
        kind = float if exact else object  # beyond, Python's own whole numbers
        qs, gs = q.astype(kind), self.g.astype(kind)
        none = -(1 << 53) if exact else -(1 << 90)
        # One number orders rows by score and id; the k greatest so far of each window.
        best = np.full((n, width, k), none, kind)
        floor, ceiling = (lo * size).astype(kind), (hi * size).astype(kind)  # windows in terms of these numbers
        rest = np.where(live, greatest, -np.inf)
        turn = np.argsort(-rest, axis=1, kind="stable")
        done, step = 0, 4
        while done < len(self.leaves):
            part = turn[:, done : done + step]
            # A leaf counts as long as it can better the last of some window.
            need = np.maximum(floor, best[:, :, -1]).min(1).astype(float) / size
            top = np.take_along_axis(rest, part, 1)
            wanted = (top > -np.inf) & (top + 1 >= need[:, None])
            if not wanted.any():
                if not (np.take_along_axis(rest, turn[:, done:], 1) + 1 >= need[:, None]).any():
                    break
            at, col = np.nonzero(wanted)
            leaf = part[at, col]
            order = np.argsort(leaf, kind="stable")
            at, leaf = at[order], leaf[order]
            edge = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))
            for p, e in zip(edge[:-1], edge[1:], strict=True):
                a, rows = at[p:e], self.leaves[leaf[p]]
                fits = label[a][:, None] == self.label[rows][None, :]
                if not same:
                    fits = ~fits
                key = np.where(fits, (qs[a] @ gs[rows].T) * size + (size - 1 - rows)[None, :], none)
                for w in range(width):
                    inside = np.where((key >= floor[a, w][:, None]) & (key < ceiling[a, w][:, None] + size), key, none)
                    both = np.concatenate((best[a, w], inside), 1)
                    best[a, w] = -np.sort(-both, axis=1)[:, :k] if kind is object else -np.partition(-both, k - 1, axis=1)[:, :k]
            if kind is float:
                best = -np.sort(-best, axis=2)
            done += step
            step *= 2
        i, w, j = np.nonzero(best > none)
        key = best[i, w, j]
        score = key // size
        return i, w, self.ids[(size - 1 - (key - score * size)).astype(np.int64)], score.astype(np.int64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of numbers with zeros at the end of shorter ones."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dim), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy()
    return out


def whole_rows(vectors: DataFrame) -> DataFrame:
    """(id, label, g) of the rows that take part; of repeated ids the least row."""
    x = F.col("embedding")
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    g = F.transform(x, lambda v: F.greatest(F.least(F.floor(v.cast("double") * 256), F.lit(MOST)), F.lit(-MOST)).cast("long"))
    label = F.col("label").cast("long")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    rows = rows.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), g.alias("g"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "g")).alias("x")).select("id", "x.label", "x.g")


class Pivots:
    """The top level: pivots with what their cells hold, and some rows that tell what an anchor finds at least."""

    def __init__(self, sample: list, cells: int, dim: int, sphere: Sphere):
        g = np.zeros((len(sample), dim), np.int64)
        for r, x in zip(g, sample, strict=True):
            r[: len(x["g"])] = x["g"]
        self.dim, self.sphere = dim, sphere
        self.label, self.g = np.array([x["label"] for x in sample]), g
        x = sphere.rows(g.astype(float))
        self.pivots = x[net(x, cells)[0]]
        self.reach = self.blocks = None

    def cell(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each row and its angle from it."""
        x = angles(self.sphere.rows(g.astype(float)) @ self.pivots.T)
        c = x.argmin(1)
        return c, x[np.arange(len(x)), c]

    def filled(self, cells: list) -> None:
        """Take the number of rows and the reach of each cell."""
        self.reach, self.blocks = np.full(len(self.pivots), -1.0), np.zeros(len(self.pivots), np.int64)
        for c in cells:
            self.reach[c["cell"]], self.blocks[c["cell"]] = c["reach"] + 1e-7, -(-c["n"] // SHARD)

    def at_least(self, q: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
        """A score that the k-th best row of each query's label reaches, as far as the sample tells."""
        out = np.full(len(q), -np.inf)
        for i in range(0, len(q), 256):
            s = np.where(label[i : i + 256, None] == self.label[None, :], q[i : i + 256].astype(float) @ self.g.T.astype(float), -np.inf)
            if s.shape[1] >= k:
                out[i : i + 256] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        return np.where(np.isfinite(out), np.floor(out - 1 - np.abs(out) * SLACK), -np.inf)

    def visited(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which cells may hold rows within [lo, hi] of each query."""
        least, greatest = self.sphere.bounds(q.astype(float), self.pivots, np.maximum(self.reach, 0))
        return (self.blocks > 0) & (greatest >= lo[:, None]) & (least <= hi[:, None])


def visits(anchors: DataFrame, pivots: Pivots, k: int) -> DataFrame:
    """A row for each anchor and block of rows that it has to search; without windows, for its k best rows."""
    known = anchors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = known.value
        for b in batches:
            if not len(b):
                continue
            q, label = matrix(b.column(2), p.dim), b.column(1).to_numpy()
            scores = b.column(3).to_pylist()
            if k:
                lo, hi = p.at_least(q, label, k), np.full(len(q), np.inf)
                lows = [[] if v == -np.inf else [int(v)] for v in lo]
            else:
                lows = [[min(-(-50 * s // 100) for s in x)] if x else [] for x in scores]
                lo = np.array([x[0] if x else np.inf for x in lows])
                hi = np.array([max((95 * s // 100 for s in x), default=-np.inf) for x in scores])
            i, c = np.nonzero(p.visited(q, lo, hi))
            again = p.blocks[c]
            block = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
            i, c = np.repeat(i, again), np.repeat(c, again)
            out = b.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(block), *(out.column(x) for x in range(4)), pa.array([lows[x] for x in i], pa.list_(pa.int64()))], names=["cell", "block", "q", "label", "g", "scores", "low"])

    return anchors.select("q", "label", "g", "scores").mapInArrow(run, "cell long, block long, q long, label long, g array<long>, scores array<long>, low array<long>")


def searched(rows: DataFrame, asked: DataFrame, pivots: Pivots, chunks: int, k: int) -> DataFrame:
    """(q, score_at, id, score): what each block of rows has for the anchors that visit it, k rows a window at most.

    Anchors look for the best rows of their own label, or, if they bring scores of positives,
    for those of other labels within the window of each score, numbered by ``score_at``.
    """
    dim, sphere = pivots.dim, pivots.sphere

    def run(key: tuple, own: pa.Table, other: pa.Table) -> pa.Table:
        found = tuple(np.zeros(0, np.int64) for _ in range(4))
        if len(own) and len(other):
            own, other = own.combine_chunks(), other.combine_chunks()
            tree = CoverTree(own["id"].to_numpy(), own["label"].to_numpy(), matrix(own["g"].chunk(0), dim), sphere)
            q, label, names = matrix(other["g"].chunk(0), dim), other["label"].to_numpy(), other["q"].to_numpy()
            scores, low = other["scores"].to_pylist(), other["low"].to_pylist()
            same = scores[0] is None
            if same:
                lo = np.array([[x[0] if x else -OPEN] for x in low], object)
                hi = np.full((len(q), 1), OPEN, object)
            else:
                width = max(map(len, scores))
                lo, hi = np.full((len(q), width), OPEN, object), np.full((len(q), width), -OPEN, object)  # empty
                for i, x in enumerate(scores):
                    lo[i, : len(x)], hi[i, : len(x)] = [-(-50 * s // 100) for s in x], [95 * s // 100 for s in x]
            i, w, ids, score = tree.search(q, label, lo, hi, same, k)
            found = names[i], w, ids, score
        return pa.table(dict(zip(("q", "score_at", "id", "score"), found, strict=True)))

    known = rows.sparkSession.sparkContext.broadcast(pivots.blocks)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.maximum(1, known.value[b.column(0).to_numpy()])
            block = np.asarray(b.column(1)) % n
            i, c = np.repeat(np.arange(len(b)), chunks), np.tile(np.arange(chunks), len(b))
            out = b.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array(block[i]), pa.array(c), *(out.column(x) for x in (2, 3, 4))], names=["cell", "block", "chunk", "id", "label", "g"])

    own = rows.select("cell", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("block"), "id", "label", "g").mapInArrow(dealt, "cell long, block long, chunk long, id long, label long, g array<long>")
    by = [F.col("cell"), F.col("block"), F.col("chunk")]
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)))
    return own.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, "q long, score_at long, id long, score long")


def hard_negatives(vectors: DataFrame, step: int = 50, positives: int = 5, negatives: int = 3) -> DataFrame:
    """For each anchor and each of its positives the hardest negatives.

    Components become floor(256 * x), labels of rows whose vec_id is divisible by 7
    (label + 1) % 10; a row's score is its inner product with the anchor. Anchors are
    rows whose vec_id is divisible by ``step``; an anchor's positives are its first
    ``positives`` other rows of its label by score (ties: the smaller vec_id); of each
    the first ``negatives`` rows of other labels with a score between a half and 95
    hundredths of the positive's are returned: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score. The result is exact.

    Rows with a null vec_id, label or vector, or with a null or non-finite component
    take no part. vec_id is a key: of repeated rows one is taken, the least by label
    and vector. A shorter vector counts as one with zeros at its end. Components
    beyond 2**26 after scaling count as that. An anchor without positives, and a
    positive without negatives, have no rows; an empty table gives none; other
    columns are ignored. Of more than six rows with one vector and label none but the
    six smallest ids can be among the best, so no more are indexed.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    every = saved(whole_rows(vectors), "negatives-rows")
    # Repeated vectors: an anchor's best rows are, of equal ones, those with the smallest ids, besides itself.
    w = Window.partitionBy("g", "label").orderBy("id")
    rows = every.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max(positives + 1, negatives)).drop("k")
    rows = saved(rows, "negatives-points")
    anchors = every.where(F.col("id") % step == 0)
    asks = saved(anchors.groupBy("g", "label").agg(F.min("id").alias("q")), "negatives-anchors")
    names = saved(anchors.join(asks, ["g", "label"]).select(F.col("id").alias("anchor_id"), "q"), "negatives-names")
    norm = F.aggregate("g", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    n, dim, most = rows.agg(F.count("*"), F.max(F.size("g")), F.max(norm)).first()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sphere = Sphere(float(np.sqrt(most or 0)) * (1 + 1e-12))
    pivots = Pivots(sample, min(PIVOTS, max(1, -(-n // SHARD))), dim or 0, sphere) if n else None
    if pivots is None:
        dropped(rows, asks, names, every)
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    known = spark.sparkContext.broadcast(pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, far = known.value.cell(matrix(b.column(2), known.value.dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c), pa.array(far)], names=["id", "label", "g", "cell", "far"])

    cells = saved(rows.select("id", "label", "g").mapInArrow(placed, "id long, label long, g array<long>, cell long, far double"), "negatives-cells")
    pivots.filled(cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("reach")).collect())
    chunks = max(1, -(-asks.count() // SHARD))

    asked = visits(asks.withColumn("scores", F.lit(None).cast("array<long>")), pivots, positives + 1)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    pos = searched(cells, asked, pivots, chunks, positives + 1).withColumn("k", F.row_number().over(best)).where(F.col("k") <= positives + 1)
    pos = saved(pos.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("k", "id", "score"))).alias("pos")), "negatives-positives")
    asked = visits(asks.join(pos, "q").select("q", "label", "g", F.col("pos.score").alias("scores")), pivots, 0)
    best = Window.partitionBy("q", "score_at").orderBy(F.desc("score"), "id")
    neg = searched(cells, asked, pivots, chunks, negatives).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    neg = saved(neg.groupBy("q").agg(F.collect_list(F.struct("score_at", "rank", "id", "score")).alias("neg")), "negatives-found")
    dropped(every, rows, asks, cells)

    both = names.join(pos, "q").join(neg, "q").withColumn("own", F.array_position(F.col("pos.id"), F.col("anchor_id")))
    each = both.select("anchor_id", "own", "pos", F.explode("neg").alias("n")).withColumn("p", F.col("pos")[F.col("n.score_at").cast("int")])
    each = each.where((F.col("p.id") != F.col("anchor_id")) & (F.col("p.k") <= F.when(F.col("own") > 0, positives + 1).otherwise(positives)))
    return each.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("n.rank").alias("rank"), F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS g
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.g, b.g)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""
