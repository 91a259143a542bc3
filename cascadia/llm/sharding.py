"""Size-tiered compaction of document shards under a versioned manifest.

Arrivals are appended as small immutable runs of Parquet files. Runs of one size
tier (each tier's runs are ``fan`` times larger than the last one's) are merged
``fan`` at a time, in order of arrival, into files of about a target size. Every
change is one new manifest version, put in place by an atomic rename that fails
if another writer has taken the version; the change is then made to the newest
version. Superseded runs stay readable through the older versions until these
are expired.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table

FAN = 4
#: Text bytes from which a run is in tier 1; each further tier starts at FAN times as many.
TIER = 1 << 20
#: Text bytes of one file of a merged run, about.
TARGET = 128 << 20
TIERS = 20
#: Folder name of rows without a value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
RUN = "run string, path string, first long, level int, rows long, bytes long"


class ShardTable:
    """A folder of immutable runs and its manifest versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("v"))

    def runs(self, version: int | None = None) -> DataFrame:
        """The manifest's runs: run, path, first (order of arrival), level (merges so far), rows, bytes of text."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], RUN)  # nothing was committed yet
        return self.spark.read.schema(RUN).json(f"{self.root}/manifest/v{found[-1] if version is None else version:08d}.json")

    def _commit(self, base: int, runs: list[dict]) -> int:
        """Put version base + 1 in place; FileAlreadyExistsException if it's there."""
        jvm = self.spark.sparkContext._jvm
        there = self._path(f"{self.root}/manifest/v{base + 1:08d}.json")
        draft = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray("\n".join(json.dumps(r) for r in sorted(runs, key=lambda r: r["first"])).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self._conf).getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context.rename(draft, there, none)
        return base + 1

    def _change(self, gone: set[str], new: list[dict]) -> int | None:
        """Commit the newest version without the runs in ``gone`` and with ``new``.

        If another writer takes the version first, the next one is tried. None, if a
        run that should go has been merged by another writer: ``new`` is then deleted.
        """
        while True:
            base = (self.versions() or [0])[-1]
            old = [r.asDict() for r in self.runs().collect()]
            if not gone <= {r["run"] for r in old}:
                for r in new:
                    self._fs.delete(self._path(r["path"]), True)
                return None
            after = max((r["first"] for r in old), default=-1) + 1
            placed = [r if gone else {**r, "first": after + i} for i, r in enumerate(new)]
            try:
                return self._commit(base, [r for r in old if r["run"] not in gone] + placed)
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise

    def append(self, docs: DataFrame, arrival: Column) -> int:
        """Append the rows of each value of ``arrival``, an integer, as a run of its own, all in one version.

        Rows without an arrival are one run too, the first. Rows of one arrival are gathered before they
        are written, a large one in several tasks, so that no task leaves a small file for each.
        """
        if docs.isEmpty():
            return self._change(set(), [])
        name, key = uuid.uuid4().hex, "arrival"
        while key in docs.columns:
            key += "_"
        path = f"{self.root}/runs/{name}"
        docs.withColumn(key, arrival.cast("int")).hint("rebalance", key).write.partitionBy(key).option("compression", "zstd").parquet(path)
        sizes = self.spark.read.parquet(path).groupBy(key).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).orderBy(key).collect()
        return self._change(set(), [{"run": f"{name}-{i}", "path": f"{path}/{key}={NO_VALUE if r[0] is None else r[0]}", "first": 0, "level": 0, "rows": r["rows"], "bytes": r["bytes"]} for i, r in enumerate(sizes)])

    def plan(self) -> DataFrame:
        """The runs to merge, with their group: ``fan`` runs in a row of one tier."""
        tier = sum((F.col("bytes") >= F.lit(TIER * FAN**i)).cast("int") for i in range(TIERS))
        place = F.row_number().over(Window.partitionBy("tier").orderBy("first")) - 1
        runs = self.runs().withColumn("tier", tier).withColumn("part", F.floor(place / FAN))
        return runs.withColumn("n", F.count("*").over(Window.partitionBy("tier", "part"))).where(F.col("n") == FAN)

    def compact(self) -> int:
        """Merge until no tier has ``fan`` runs; one job and one version for each round."""
        while True:
            groups = self.plan().groupBy("tier", "part").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.collect_list("run").alias("runs"), F.min("first").alias("first"), (F.max("level") + 1).alias("level"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).collect()
            if not groups:
                return (self.versions() or [0])[-1]
            name, merged, new = uuid.uuid4().hex, [], []
            path = f"{self.root}/runs/{name}"
            for i, g in enumerate(groups):
                part = self.spark.read.parquet(*g["paths"])
                key = "merged"
                while key in part.columns:
                    key += "_"
                merged.append(part.coalesce(max(1, -(-g["bytes"] // TARGET))).withColumn(key, F.lit(i)))
                new.append({"run": f"{name}-{i}", "path": f"{path}/{key}={i}", "first": g["first"], "level": g["level"], "rows": g["rows"], "bytes": g["bytes"]})
            reduce(DataFrame.unionByName, merged).write.partitionBy(key).option("compression", "zstd").parquet(path)
            self._change({r for g in groups for r in g["runs"]}, new)

    def expire(self, keep: int = 1) -> None:
        """Delete all versions but the last ``keep``, and the runs that none of these holds."""
        versions = self.versions()
        stay = {r["path"] for v in versions[-keep:] for r in self.runs(v).select("path").collect()}
        for v in versions[:-keep]:
            for r in self.runs(v).select("path").collect():
                if r["path"] not in stay:
                    self._fs.delete(self._path(r["path"]), True)
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:08d}.json"), True)

    def read(self, like: DataFrame, version: int | None = None) -> DataFrame:
        """All documents of a version, with their run's first, level, rows and bytes as run_first and so on.

        With no runs, an empty table like ``like``; a ``like`` of other columns than the runs' is refused. A document's own column of such
        a name stays, and the run's takes a further underscore.
        """
        runs = self.runs(version)
        paths = [r["path"] for r in runs.select("path").collect()]
        names = {}
        for n in ("first", "level", "rows", "bytes"):
            names[n] = f"run_{n}"
            while names[n] in like.columns:
                names[n] += "_"
        if not paths:
            return like.where("false").select("*", *(F.lit(0).cast("int" if n == "level" else "long").alias(x) for n, x in names.items()))
        there = self.spark.read.parquet(paths[0]).schema
        if [(f.name, f.dataType) for f in there] != [(f.name, f.dataType) for f in like.schema]:
            raise ValueError(f"the shards hold {there.simpleString()}, not {like.schema.simpleString()}")
        # Paths differ in their scheme's slashes; what follows runs/ names the run.
        key = lambda c: F.regexp_extract(c, "/runs/(.*)$", 1)
        at = key(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))
        docs = self.spark.read.schema(like.schema).parquet(*paths).select(F.struct(*like.columns).alias("row"), at.alias("run_key"))
        of = runs.select(key(F.col("path")).alias("run_key"), *(F.col(n).alias(x) for n, x in names.items()))
        return docs.join(of, "run_key").select("row.*", *names.values())


def shard_documents(docs: DataFrame, root: str, arrivals: int = 12) -> ShardTable:
    """Append documents in ``arrivals`` runs by doc_id and compact them.

    A null doc_id arrives first; null texts count no bytes; repeated rows stay;
    an empty table has no runs; other columns are kept, whatever their names.
    """
    shards = ShardTable(docs.sparkSession, root)
    shards.append(docs, F.coalesce(F.pmod("doc_id", F.lit(arrivals)), F.lit(0)))
    shards.compact()
    return shards


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies after its arrival was appended and compacted."""
    root = f"{shared_dir(spark)}/shards/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    shards = shard_documents(docs, root)
    shards.expire()
    return shards.read(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "run_first", "run_level", "run_rows", "run_bytes")


_TIER = " + ".join(f"(bytes >= {TIER * FAN**i})::INT" for i in range(TIERS))


def _pass(k: int) -> str:
    return f"""
t{k} AS (SELECT *, {_TIER} AS tier FROM r{k}),
p{k} AS (SELECT *, floor((row_number() OVER (PARTITION BY tier ORDER BY first) - 1) / {FAN}.0) AS part FROM t{k}),
n{k} AS (SELECT *, count(*) OVER (PARTITION BY tier, part) AS n FROM p{k}),
m{k} AS (SELECT run, CASE WHEN n = {FAN} THEN min(first) OVER (PARTITION BY tier, part) ELSE first END AS new_first,
         CASE WHEN n = {FAN} THEN max(level) OVER (PARTITION BY tier, part) + 1 ELSE level END AS new_level FROM n{k}),
a{k + 1} AS (SELECT a.arrival, m.new_first AS run, m.new_level AS level, a.rows, a.bytes FROM a{k} a JOIN m{k} m ON a.run = m.run),
r{k + 1} AS (SELECT run, run AS first, max(level) AS level, sum(rows) AS rows, sum(bytes) AS bytes FROM a{k + 1} GROUP BY run)"""


#: Twelve arrivals take two rounds at most.
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id % 12, 0) AS arrival, octet_length(encode(text))::BIGINT AS n_bytes FROM documents),
s AS (SELECT arrival, count(*) AS rows, coalesce(sum(n_bytes), 0) AS bytes FROM d GROUP BY arrival),
a0 AS (SELECT arrival, row_number() OVER (ORDER BY arrival) - 1 AS run, 0 AS level, rows, bytes FROM s),
r0 AS (SELECT run, run AS first, level, rows, bytes FROM a0),{_pass(0)},{_pass(1)},{_pass(2)}
SELECT d.doc_id, d.n_bytes, r.first::BIGINT AS run_first, r.level::INT AS run_level, r.rows::BIGINT AS run_rows, r.bytes::BIGINT AS run_bytes
FROM d JOIN a3 a ON d.arrival = a.arrival JOIN r3 r ON a.run = r.run
"""
