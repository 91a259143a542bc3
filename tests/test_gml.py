"""Graphs in files: what is written is read back."""

from __future__ import annotations

import pytest
from cascadia.sources import gml
from cascadia.sources import projections as P
from pyspark.sql import functions as F


def test_graphs_are_read_as_written(spark, tmp_path):
    edges = P.edges(spark, "/root/testdata/sf0.001")
    levels = spark.createDataFrame([("grid_0.1",), ("grid_0.2",)], "graph string")
    e = edges.crossJoin(levels).select("graph", F.lit("edge").alias("kind"), F.lit(None).cast("long").alias("id"), F.col("u").cast("long").alias("source"), F.col("v").cast("long").alias("target"), F.create_map(F.lit("weight"), F.col("weight").cast("string"), F.lit("edge_idx"), F.col("edge_idx").cast("string")).alias("attributes"))
    names = F.when(F.col("id") == 3, F.lit('a "b" & ü <c>\n[d]')).when(F.col("id") == 4, "").otherwise(F.concat(F.lit("bus "), F.col("id")))
    n = spark.range(25).crossJoin(levels).select("graph", F.lit("node").alias("kind"), "id", F.lit(None).cast("long").alias("source"), F.lit(None).cast("long").alias("target"), F.create_map(F.lit("label"), names, F.lit("pos.x"), F.lit("1.5"), F.lit("pos.y"), F.lit("-2e-05")).alias("attributes"))
    table = n.unionByName(e)
    folder = f"{tmp_path}/graphs"
    gml.write_graphs(table, folder)
    rows = lambda df: sorted((r.graph, r.kind, r.id or -1, r.source or -1, r.target or -1, sorted(r.attributes.items())) for r in df.collect())
    got = gml.read_graphs(spark, folder)
    assert rows(got) == rows(table) and got.rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="exists"):
        gml.write_graphs(table, folder)
    gml.write_graphs(table.where("graph = 'grid_0.1' and kind = 'node'"), folder, overwrite=True)
    assert gml.read_graphs(spark, folder).groupBy("graph").count().orderBy("graph").collect() == [("grid_0.1", 25), ("grid_0.2", 75)]


def test_other_writers_files():
    text = 'Creator "x"\n# a remark\ngraph [ directed 0 name "g"\n node [ id 1 label "A&amp;B" graphics [ x 1.0 w [ z 2 ] ] ]\n node [\n id 2\n ]\n edge [ source 1 target 2 value 3 ]\n]\n'
    assert list(gml.parsed(text)) == [("node", {"id": "1", "label": "A&B", "graphics.x": "1.0", "graphics.w.z": "2"}), ("node", {"id": "2"}), ("edge", {"source": "1", "target": "2", "value": "3"})]
    assert list(gml.parsed("")) == [] and list(gml.parsed("graph [ node [ id 5")) == [("node", {"id": "5"})]
