"""Studies side by side: small cases by hand."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cascadia.operators import dispatch as D
from cascadia.operators import planning as N
from cascadia.operators import splits as S
from cascadia.operators import vectors as V


def test_distances_and_their_histogram(spark):
    flows = spark.createDataFrame([(0.0, 1, -3.0, 2.0), (0.0, 1, 1.0, 4.0), (0.0, 2, 2.0, 2.0), (0.5, 1, None, 1.0), (0.5, 2, 20.0, 1.0)], "co2l double, snapshot int, p0 double, length double")
    made = spark.createDataFrame([(0.0, 1, 4.0, 1), (0.0, 1, 3.0, -1), (0.5, 2, 0.0, 1)], "co2l double, snapshot int, p double, sign int")
    stored = spark.createDataFrame([(0.0, 1, 4.0), (0.0, 1, -9.0)], "co2l double, snapshot int, p double")
    power = D.transmitted_power(made, stored)
    assert {tuple(r) for r in power.collect()} == {(0.0, 1, 5.0), (0.5, 2, 0.0)}
    assert {tuple(r) for r in D.flow_distances(flows, power).collect()} == {(0.0, 1, 2.0), (0.0, 2, None), (0.5, 1, None), (0.5, 2, None)}
    series = D.flow_distances(flows, unit=1.0)
    assert {tuple(r) for r in series.collect()} == {(0.0, 1, 10.0), (0.0, 2, 4.0), (0.5, 1, None), (0.5, 2, 20.0)}
    weights = spark.createDataFrame([(0.0, 1, 1), (0.0, 2, 3), (0.5, 1, 1), (0.5, 2, 1)], "co2l double, snapshot int, w int")
    got = {(r.co2l, r.bin): r.share for r in D.distance_histogram(series, weights, 4).collect()}
    assert got == {(0.0, 1): 0.25, (0.0, 0): 0.75, (0.5, 3): 0.5}
    one = D.distance_histogram(series.where("flow_distance = 4"), weights, 4).collect()
    assert [(r.bin, r.share) for r in one] == [(3, 0.75)]
    assert D.distance_histogram(series.where("false"), weights, 4).count() == 0


def test_cases_of_batches(spark):
    rows = [(1, 3, 4, 1, 1, True), (1, 3, 4, 2, 1, False), (1, 3, 4, 1, 9, True), (1, 4, 3, 1, 1, True), (2, 0, 0, 1, 1, True), (2, 0, 0, 1, 1, True)]
    batched = spark.createDataFrame(rows, "time_stamp int, edge_0 int, edge_1 int, circuits_0 int, circuits_1 int, splits boolean")
    assert {tuple(r) for r in S.largest_cases(batched).collect()} == {(1, 3, 4, 2, 1, False), (1, 4, 3, 1, 1, True), (2, 0, 0, 1, 1, True)}
    old = spark.createDataFrame([(1,), (1,), (1,), (5,)], "time_stamp int")
    assert {tuple(r) for r in S.case_counts(old, batched).collect()} == {(1, 3, 1, 2, 1), (2, 0, 1, -1, 0), (5, 1, 0, 1, 0)}


def test_main_components(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5, 0.2, 0.1],), ([0.1, 0.3, 0.3],), ([0.4],), ([],)], "v array<double>")
    got = df.select(V.main_component(F.col("v"), "largest").alias("a"), V.main_component(F.col("v"), "most_frequent").alias("b")).collect()
    assert [tuple(r) for r in got] == [([0, 1, 1, 0, 0], [1, 0, 0, 1, 0]), ([0, 1, 1], [0, 1, 1]), ([1], [1]), ([], [])]
    with pytest.raises(ValueError, match="unknown"):
        V.main_component(F.col("v"), "other")


def test_nodes_in_one_component(spark):
    c = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, 2.0), (1, 1, 2, -3.0)], "split_number long, component_number int, node_idx int, rocof double")
    assert V.exact_nodal_values(c, 3).first().v == [2.0, 2.0, -3.0]
    for more, found in (((1, 1, 0, -3.0), (1, 1, 0)), ((2, 0, 0, 1.0), (2, 0, 2))):
        bad = c.union(spark.createDataFrame([more], c.schema))
        assert [tuple(r) for r in V.misplaced_nodes(bad, 3).collect()] == [found]
        with pytest.raises(ValueError, match="split"):
            V.exact_nodal_values(bad, 3)


def test_walks_between_classes(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "u int, v int")
    adj = np.diag([1, 1, 1], 1) + np.diag([1, 1, 1], -1)
    vectors = [[1, 1, 0, 0], [1, -1, -1, 1]]
    x = spark.createDataFrame(list(enumerate(vectors)), "key long, v array<int>")
    got = {r.key: r.katz for r in V.typed_katz_walks(x, "key", "v", edges, 3, 0.5).collect()}
    for key, v in enumerate(vectors):
        signed = np.where(np.array(v) == 1, 1, -1)
        assert np.allclose(got[key], sum(np.linalg.matrix_power(adj, d) @ signed * 0.5**d for d in (1, 2, 3)))
    for bad in ([1, 0, -1, 1], [1, 1, 1, 1], [0, 0, 0, 0], [2, 1, 0, 0]):
        with pytest.raises(Exception, match="classes must be"):
            V.typed_katz_walks(spark.createDataFrame([(0, bad)], x.schema), "key", "v", edges).collect()


def test_calendar(spark):
    times = [dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 7, 6), dt.datetime(2024, 6, 3, 6), dt.datetime(2024, 4, 6, 12)]
    df = spark.createDataFrame([(t,) for t in times], "snapshot timestamp_ntz")
    found = lambda **k: {times.index(r.snapshot) for r in D.on_calendar(df, **k).collect()}
    assert found() == {0, 1, 2, 3} and found(months=[1, 6]) == {0, 1, 2} and found(weekdays=[0]) == {0, 2}
    assert found(seasons=["winter"]) == {0, 1} and found(hours=[6], weekdays=[6]) == {1} and found(hours=[]) == set()


def test_dipoles_from_the_middle_of_buses(spark):
    buses = spark.createDataFrame([(40.0, 0.0), (50.0, 20.0)], "lat double, lon double")
    dipoles = spark.createDataFrame([(1, 0.0, 1e6), (2, 0.0, 0.0)], "snapshot int, dipole_x double, dipole_y double")
    got = {r.snapshot: r.km for r in N.inhomogeneity_at(dipoles, buses).collect()}
    assert got[1] == pytest.approx(111.195, abs=0.01) and got[2] == 0
    with pytest.raises(Exception, match="no valid position"):
        N.inhomogeneity_at(dipoles, buses, 1e3).collect()
