"""Near-duplicate vectors by spherical-cap filters of structured random product codes.

The (randomly rotated) dimensions fall into blocks and each block has a few
random unit directions; a filter direction joins one of each block, so that a
few tables stand for tens of thousands of filters. A vector is list-decoded to
all filters that it exceeds, those whose inner product comes within a slack of
its best, block by block without a look at the others. Vectors meet in the
filters they share and are verified there by their exact cosine. A pair counts
in one filter only, the first of those that both exceed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dropped, saved, small_batches, table

BLOCKS = 3
#: Directions of a block at least; with more vectors there are more, so that filters stay small.
DIRECTIONS = 16
#: How far below its best a filter's inner product may lie, for unit vectors of 64
#: dimensions. Inner products with a block's directions shrink as the root of the dimension grows, and the slack with them.
SLACK = 0.12
#: Vectors of one side of a comparison; a fuller filter is split into pairs of such blocks.
SIDE = 1024


class ProductCode:
    """Directions of all blocks for vectors of one dimension."""

    def __init__(self, dim: int, directions: int = DIRECTIONS, seed: int = 11):
        r = np.random.default_rng([seed, dim])
        self.n, self.scale = directions, (64 / dim) ** 0.5
        self.rotation = np.linalg.qr(r.normal(size=(dim, dim)))[0]
        self.parts = np.array_split(np.arange(dim), min(BLOCKS, dim))
        self.directions = []
        for p in self.parts:
            d = r.normal(size=(len(p), directions))
            self.directions.append(d / np.linalg.norm(d, axis=0))

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Inner products with each direction of each block, (vector, block, direction)."""
        x = unit @ self.rotation
        return np.stack([x[:, p] @ d for p, d in zip(self.parts, self.directions, strict=True)], 1)

    def decode(self, unit: np.ndarray, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) for all filters within the slack of each vector's best."""
        t = self.tables(unit)
        loss = t.max(2, keepdims=True) - t
        row, code, lost = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for b in range(t.shape[1]):
            total = lost[:, None] + loss[row, b]
            i, k = np.nonzero(total <= slack * self.scale)
            row, code, lost = row[i], code[i] * self.n + k, total[i, k]
        return row, code

    def first_shared(self, unit: np.ndarray, code: int, i: np.ndarray, j: np.ndarray, slack: float = SLACK) -> np.ndarray:
        """Whether no filter before ``code`` is exceeded by both vectors of a pair (i, j)."""
        row, codes = self.decode(unit, slack)
        row, codes = row[codes < code], codes[codes < code]
        order = np.argsort(row, kind="stable")
        row, codes = row[order], codes[order]
        at = np.searchsorted(row, np.arange(len(unit) + 1))
        held = np.sort(row * self.n ** len(self.parts) + codes)
        size = (at[1:] - at[:-1])[i]
        pair = np.repeat(np.arange(len(i)), size)
        own = codes[at[i][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)]
        key = j[pair] * self.n ** len(self.parts) + own
        found = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key if len(held) else np.zeros(0, bool)
        first = np.ones(len(i), bool)
        first[pair[found]] = False
        return first


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(embedding, rid, copies): distinct usable vectors, rid the smallest vec_id of equal ones."""
    e = F.col("embedding")
    usable = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.where(usable & F.col("vec_id").isNotNull()).groupBy("embedding").agg(F.min("vec_id").alias("rid"), F.count("*").alias("copies"))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def filter_rows(distinct: DataFrame, slack: float, directions: int) -> DataFrame:
    """(dim, filter, rid, copies) for each filter of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, rid, copies = b.column(0), np.asarray(b.column(1)), np.asarray(b.column(2))
            size = np.array([len(x) for x in e])
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                x = np.array([e[int(i)].as_py() for i in rows], e.type.value_type.to_pandas_dtype())
                unit = _units(x.astype(np.float64))
                for at in range(0, len(rows), 512):
                    part = unit[at : at + 512]
                    row, code = ProductCode(int(dim), directions).decode(part, slack)
                    own = rows[at : at + 512][row]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), dim), pa.int64()), pa.array(code), pa.array(rid[own]), pa.array(copies[own])], names=["dim", "filter", "rid", "copies"])

    return distinct.select("embedding", "rid", "copies").mapInArrow(run, "dim long, filter long, rid long, copies long")


def compare(rows: DataFrame, least: float, slack: float, directions: int) -> DataFrame:
    """Links within filters: rows (rid, n, comp) with link counts, and with edges to a local component."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        dim, code, one, two = (k.as_py() for k in key)
        rid, copies, block = (t.column(x).to_numpy() for x in ("rid", "copies", "block"))
        unit = _units(t.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64))
        a, b = np.flatnonzero(block == one), np.flatnonzero(block == two)
        n, label = np.zeros(len(rid), np.int64), rid.copy()
        if len(a) and len(b):
            link = unit[a] @ unit[b].T >= least
            i, j = np.nonzero(link)
            keep = i < j if one == two else np.ones(len(i), bool)
            i, j = a[i[keep]], b[j[keep]]
            if len(i):
                product = ProductCode(dim, directions)
                for at in range(0, len(i), 1 << 15):
                    p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                    here = product.first_shared(unit, code, p, q, slack)
                    n += np.bincount(p[here], copies[q[here]], len(rid)).astype(np.int64) + np.bincount(q[here], copies[p[here]], len(rid)).astype(np.int64)
                while True:  # smallest rid of the linked vectors here
                    new = label.copy()
                    np.minimum.at(new, i, label[j])
                    np.minimum.at(new, j, new[i])
                    if (new == label).all():
                        break
                    label = new
        some = (n > 0) | (label != rid)
        return pa.table({"rid": rid[some], "n": n[some], "comp": label[some]})

    return rows.groupBy("dim", "filter", "one", "two").applyInArrow(run, "rid long, n long, comp long")


def near_vectors(vectors: DataFrame, least: float = 0.9, slack: float = SLACK) -> DataFrame:
    """Link vectors with a cosine of ``least`` or more, computed in double precision.

    Returns one row per vector: vec_id (a key), n_links (other vectors linked
    directly), component_id (the smallest vec_id reachable by links, itself
    included), kept (vec_id = component_id). Every reported link is exact, and a
    vector has links if and only if its component holds another one; a link is
    missed if no filter is exceeded by both ends. The number of directions of a
    block grows with the cube root of the number of vectors, so that filters stay
    small; with it a vector exceeds more of them and recall stays. A null vec_id
    counts as no link's end: such a row has the links and the component of the
    rows with its vector, or no link and a null component.
    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, and those of different lengths don't link. Equal vectors
    are compared once and counted each; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    distinct = saved(unit_vectors(vectors), "vectors")
    directions = max(DIRECTIONS, round((distinct.count() / 12) ** (1 / BLOCKS)))
    rows = saved(filter_rows(distinct, slack, directions), "filters")
    full = rows.groupBy("dim", "filter").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / SIDE).cast("int"))
    dealt = rows.join(full, ["dim", "filter"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    # Ids go through the filters; only those that meet others there take their vectors along.
    met = dealt.join(distinct.select("rid", "embedding"), "rid").select("dim", "filter", "one", "two", "rid", "copies", "block", "embedding")
    found = saved(compare(met, least, slack, directions), "links")
    dropped(rows)
    links = found.groupBy("rid").agg(F.sum("n").alias("n"))
    comp = components(found.where("rid <> comp").select(F.col("rid").alias("a"), F.col("comp").alias("b")))
    of = distinct.join(links, "rid", "left").join(comp.select(F.col("node").alias("rid"), "comp"), "rid", "left")
    of = of.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "rid").alias("component_id"))
    out = vectors.select("vec_id", "embedding").join(of, "embedding", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors at a cosine of 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
