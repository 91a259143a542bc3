"""Results on disk and in batches: scenarios, merging, coverage, reassembly."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary one is used only where it is missing and the master is local, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts the lineage, survives lost executors and gives the optimizer true sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scenarios(df: DataFrame, without: list[float] | None = None) -> list[float]:
    """The scenario levels of a table, descending."""
    rows = df.select("co2l").distinct().where(~F.col("co2l").isin(without or [])).orderBy(F.desc("co2l")).collect()
    return [r[0] for r in rows]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def write(df: DataFrame, path: str, overwrite: bool = False, by: str | None = "co2l") -> None:
    """Write Parquet by scenario; refuses to overwrite unless told to."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd")
    (w.partitionBy(by) if by and by in df.columns else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def load_or_compute(spark: SparkSession, root: str, config: dict, compute) -> DataFrame:
    """The table cached under a digest of its sorted configuration, computed where it's missing."""
    path = f"{root}/{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        write(compute(), path, overwrite=True, by=None)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return hashlib.sha256(repr((df.dtypes, *map(str, r))).encode()).hexdigest()[:16]


def cached_for(network: DataFrame, root: str, compute) -> DataFrame:
    """What ``compute`` makes of a network, cached under the digest of its rows: another network is never read in its place."""
    return load_or_compute(network.sparkSession, root, {"network": digest(network)}, lambda: compute(network))


def run_study(cells: DataFrame, keys: list[str], root: str, solve, most_lots: int | None = None) -> DataFrame:
    """Results of a study of many cells, resumed where it was left: all results so far.

    ``cells`` has the keys and what ``solve`` needs to turn some of them into results that keep
    the keys. The unit of work is a lot, the cells that share all keys but the last; lots are
    partitions of the result table, overwritten one by one (dynamic overwrite), so
    that a lot is there as a whole or not at all. Lots whose every cell has a result are
    left as they are. ``most_lots`` bounds the lots of one call; the order is that of their keys.
    """
    spark, by = cells.sparkSession, keys[:-1]
    want = cells.groupBy(*by).agg(F.count_distinct(keys[-1]).alias("n"))
    if _exists(spark, root):
        done = spark.read.parquet(root).groupBy(*by).agg(F.count_distinct(keys[-1]).alias("n"))
        # Partition columns are read back as they are written.
        done = done.select(*[F.col(k).cast(dict(cells.dtypes)[k]).alias(k) for k in by], "n")
        want = want.join(done, [*by, "n"], "left_anti")
    lots = want.select(*by).orderBy(*by)
    lots = scratch(lots.limit(most_lots) if most_lots is not None else lots)
    if not lots.isEmpty():
        out = solve(cells.join(F.broadcast(lots), by, "left_semi"))
        out.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)
    return spark.read.parquet(root) if _exists(spark, root) else solve(cells.where("false"))


def unfinished(work: DataFrame, done: DataFrame, key: str = "snapshot") -> DataFrame:
    """What is left of a campaign after some snapshots have been finished."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def merge_batches(batches: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """One row for each key: that of the last batch."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie))
    return batches.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def coverage(df: DataFrame, time: str, expected: int) -> DataFrame:
    """First and last time, rows, distinct times, whether times repeat, and how many are missing."""
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(time).alias("n"), F.count_distinct(time).alias("n_distinct")).withColumn("repeated", F.col("n") > F.col("n_distinct")).withColumn("missing", F.lit(expected) - F.col("n_distinct"))


def overlay(base: DataFrame, window: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The base table with a window's values put over it where it has any."""
    w = window.select(*keys, F.col(value).alias("over"))
    return base.join(w, keys, "full").select(*keys, F.coalesce("over", value).alias(value))


def nearest_level(df: DataFrame, levels: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows with the nearest level, if it is closer than the tolerance; of equally near ones the lower.

    Both sides meet on cells twice as wide as the tolerance, a level in its own and
    the neighbouring ones, so that the join is one of equal keys.
    """
    cell = lambda c: F.floor(c / (2 * tolerance))
    near = levels.withColumn("_cell", F.explode(F.array(*(cell(F.col("level")) + k for k in (-1, 0, 1)))))
    gap = F.abs(F.col("co2l") - F.col("level"))
    found = df.select("co2l").distinct().withColumn("_cell", cell(F.col("co2l"))).join(near, "_cell").where(gap < tolerance)
    best = found.groupBy(F.col("co2l").alias("_own")).agg(F.min_by(F.struct(*levels.columns), F.struct(gap, F.col("level"))).alias("_level"))
    return df.join(best, df["co2l"] == best["_own"]).select(*[df[c] for c in df.columns], "_level.*")


def highest_entry(df: DataFrame, keys: list[str], by: list[str], value: str) -> DataFrame:
    """The value of the entry with the greatest tuple ``by`` of each key."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*by)).alias(value), F.count("*").alias("entries"))
