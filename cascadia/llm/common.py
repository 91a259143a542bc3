"""Helpers that several operators share: tables, scratch tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts may be long, so batches hold few rows.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for checkpoints and scratch tables.

    It is the one in ``spark.checkpoint.dir``; a temporary folder is used only
    where that setting is missing and the master is local, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table in the shared folder and read it back.

    This cuts the lineage, survives lost executors and gives the optimizer the
    true size of the table, so that it can pick a broadcast where that is safe.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables that ``saved`` returned; nothing lazy may still read them."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """(doc_id, count) of ids that more than one row has; None if there are none, as doc_id should be a key."""
    found = saved(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1"), "repeated-ids")
    if found.isEmpty():
        dropped(found)
        return None
    return found


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores at its end until no column is named so."""
    while name in taken:
        name += "_"
    return name


def placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that is unique and in order of doc_id, null where that is null, and its name.

    It is doc_id itself if that is a key. Otherwise rows of one doc_id are numbered, in the
    order of their partitions, and ids are replaced by their ranks. Rows that share an id are
    written, so that their numbers stay; no group is gathered in one task.
    """
    again = repeated_ids(docs)
    if again is None:
        return docs, "doc_id"
    names = docs.columns
    place, row, rank, key = (unused(x, names) for x in ("place_", "row_", "rank_", "id_"))
    ids = again.select("doc_id")
    shared = saved(docs.join(ids, "doc_id", "left_semi").select(*names, F.monotonically_increasing_id().alias(row)), "shared-ids")
    # Numbers run within a part of the table, after those of the parts before it.
    part = F.shiftright(row, 33)
    sizes = shared.groupBy("doc_id", part.alias("part_")).agg(F.count("*").alias("n_")).withColumn("before_", F.sum("n_").over(Window.partitionBy("doc_id").orderBy("part_")) - F.col("n_"))
    own = shared.select("doc_id", F.col(row).alias("at_"), part.alias("part_")).withColumn("k_", F.row_number().over(Window.partitionBy("doc_id", "part_").orderBy("at_")))
    numbers = own.join(sizes, ["doc_id", "part_"]).select(F.col("at_").alias(row), (F.col("k_") + F.col("before_")).alias(place))
    rows = shared.join(numbers, row).select(*names, place).union(docs.where("doc_id is not null").join(ids, "doc_id", "left_anti").select(*names, F.lit(0).cast("long").alias(place)))
    # Ranks of ids: places in sorted parts, after those of the parts before.
    order = saved(docs.where("doc_id is not null").select(F.col("doc_id").alias(key)).distinct().orderBy(key).withColumn("at_", F.monotonically_increasing_id()), "ids")
    low = F.col("at_").bitwiseAND((1 << 33) - 1)
    parts = order.groupBy(F.shiftright("at_", 33).alias("part_")).agg(F.count("*").alias("n_")).withColumn("before_", F.sum("n_").over(Window.orderBy("part_")) - F.col("n_"))  # a row for each part
    ranks = order.withColumn("part_", F.shiftright("at_", 33)).join(F.broadcast(parts), "part_").select(key, (low + F.col("before_")).alias(rank))
    most = again.agg(F.max("count")).first()[0] + 1
    out = rows.join(ranks, F.col("doc_id") == F.col(key)).select(*names, (F.col(rank) * most + F.col(place)).alias(place))
    return out.union(docs.where("doc_id is null").withColumn(place, F.lit(None).cast("long"))), place


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches that carry whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, comp), comp the smallest node.

    Each round takes the smallest label among the neighbours by a partially
    aggregated minimum and then jumps along the labels, so that the number of
    rounds grows with the logarithm of the longest path. Loops, repeated edges
    and null ends are allowed; a node is returned once; no edges, no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = saved(e.union(e.select("v", "u")).distinct(), "edges")
    old = saved(e.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("comp")), "labels")
    for _ in range(most_rounds):
        labels = old.select("node", "comp")
        near = e.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("comp").alias("up"))
        new = step.join(up, "mid").select("node", F.least("mid", "up").alias("comp"), (F.least("mid", "up") < F.col("was")).alias("changed"))
        new = saved(new, "labels")
        dropped(old)
        old = new
        if new.where("changed").isEmpty():
            dropped(e)
            return new.select("node", "comp")
    raise RuntimeError("the components did not settle")


def filtered(docs: DataFrame, start: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, all their columns, whose texts pass; ``start`` runs once in each task and returns the test."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = start()
        for b in batches:
            yield b.filter(pa.array(passes(b.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
