"""Shards of arrivals that are null or large, and tables of another kind."""

from __future__ import annotations

import os

import pytest
from cascadia.llm import sharding
from pyspark.sql import functions as F


def test_arrivals_without_a_value_are_a_run(spark, tmp_path):
    docs = spark.range(0, 200, 1, 16).select("id", F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit(1).alias("arrival"))
    shards = sharding.ShardTable(spark, f"file://{tmp_path}/t")
    shards.append(docs, F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    assert sorted(r.id for r in shards.read(docs).collect()) == list(range(200))
    runs = shards.runs().orderBy("first").collect()
    assert [r.rows for r in runs] == [67, 67, 66]
    # Each arrival was gathered before it was written: far fewer files than 16 tasks by 3 arrivals.
    files = [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")]
    assert len(files) <= 6
    for _ in range(3):
        shards.append(docs.limit(0), F.lit(None))
        shards.append(docs, F.lit(None))
    shards.compact()
    assert shards.read(docs).count() == 800 and shards.runs().count() < 6


def test_tables_of_another_kind_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    shards = sharding.ShardTable(spark, f"file://{tmp_path}/t")
    shards.append(docs, F.lit(0))
    with pytest.raises(ValueError):
        shards.read(docs.withColumn("doc_id", F.col("doc_id").cast("string")))
    with pytest.raises(ValueError):
        shards.read(docs.select("text", "doc_id"))
