from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from starloom.operators import spatial

COLUMNS = "id long, g string, x double, y double, z double, box double"


def brute_force(rows, radius):
    out = {}
    for g in {r[1] for r in rows}:
        members = [r for r in rows if r[1] == g]
        p, box = np.array([r[2:5] for r in members]), members[0][5]
        gap = np.abs(p[:, None] - p[None])
        gap = np.minimum(gap, box - gap)
        d2 = (gap**2).sum(-1)
        for i, r in enumerate(members):
            others = np.delete(d2[i], i)
            near = float(np.sqrt(others.min())) if len(others) else float("inf")
            out[r[0]] = (near, int((others <= radius * radius).sum()))
    return out


def neighbours(spark, rows, radius, **bounds):
    df = spark.createDataFrame(rows, COLUMNS)
    out = spatial.periodic_neighbours(df, "g", ["id"], ["x", "y", "z"], "box", radius, **bounds)
    return {r["id"]: (r["nearest"], r["n_within"]) for r in out.collect()}


@pytest.fixture(scope="module")
def mixed():
    """An even group, a clump across the box corner with exact copies, a pair, and a lone object."""
    rng = np.random.default_rng(11)
    clump = np.mod(np.array([24.95, 0.05, 12.0]) + rng.normal(size=(150, 3)) * 0.05, 25.0)
    parts = [
        ("even", rng.random((150, 3)) * 25.0, 25.0),
        ("clump", np.vstack([clump, rng.random((30, 3)) * 25.0, np.tile([3.0, 3.0, 3.0], (40, 1))]), 25.0),
        ("pair", np.array([[0.1, 0, 0], [24.9, 0, 0]]), 25.0),
        ("lone", np.array([[1.0, 2, 3]]), 25.0),
        ("unit", rng.random((40, 3)), 1.0),
    ]
    rows = []
    for g, points, box in parts:
        rows += [(len(rows) + i, g, *map(float, p), box) for i, p in enumerate(points)]
    return rows


@pytest.mark.parametrize(
    ("radius", "cell", "pair"),
    [(1.0, 64, 16_384), (1.0, 4, 64), (9.0, 8, 256)],
    ids=["plain", "refined", "wider than a third of the box"],
)
def test_against_brute_force(spark, mixed, radius, cell, pair):
    got = neighbours(spark, mixed, radius, crowded_cell=cell, crowded_pair=pair)
    want = brute_force(mixed, radius)
    assert set(got) == set(want)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    for k, (near, _) in want.items():
        assert got[k][0] == near or got[k][0] == pytest.approx(near, abs=1e-12)


def test_groups_never_mix_and_radius_is_inclusive(spark):
    rows = [(1, "a", 1.0, 0.0, 0.0, 25.0), (2, "a", 2.0, 0.0, 0.0, 25.0), (3, "b", 1.0, 0.0, 0.0, 25.0), (4, "b", 2.0, 0.0, 0.0, 25.0)]
    assert neighbours(spark, rows, 1.0) == dict.fromkeys((1, 2, 3, 4), (1.0, 1))
    df = spark.createDataFrame(rows, COLUMNS)
    tiny = spatial.radius_count(df, "g", ["id"], ["x", "y", "z"], "box", 0.001)
    assert {r["n_within"] for r in tiny.collect()} == {0}


def test_lone_object_is_infinitely_far(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1.0, 1.0, 25.0)], COLUMNS)
    out = spatial.nearest_distance(df, "g", ["id"], ["x", "y", "z"], "box").first()
    assert out["nearest"] == float("inf")


@pytest.mark.parametrize("x", [25.0, -0.1, float("nan")])
def test_position_outside_the_box_raises(spark, x):
    with pytest.raises(PySparkException, match="outside"):
        neighbours(spark, [(1, "a", x, 0.0, 0.0, 25.0)], 1.0)


def test_null_groups_are_groups(spark):
    rows = [(1, None, 1.0, 1.0, 10.0), (2, None, 1.5, 1.0, 10.0), (3, "a", 1.2, 1.0, 10.0)]
    df = spark.createDataFrame(rows, "k long, g string, x double, y double, box double")
    near = {r["k"]: r for r in spatial.radius_count(df, "g", ["k"], ["x", "y"], "box", 1.0).collect()}
    assert sorted(near) == [1, 2, 3]
    assert sorted(spatial.nearest_distance(df, "g", ["k"], ["x", "y"], "box").select("k").toPandas()["k"]) == [1, 2, 3]


def test_a_far_position_meets_few_members_of_a_cluster(spark):
    rng = np.random.default_rng(3)
    cluster = 40.0 + rng.random((4000, 3)) * 0.5
    rows = [(i, "a", *map(float, p), 100.0) for i, p in enumerate(cluster)]
    rows += [(5000, "a", 90.0, 90.0, 90.0, 100.0), (5001, "a", 41.5, 40.2, 40.2, 100.0)]
    places = spatial.distinct_places(spark.createDataFrame(rows, COLUMNS), "g", ["x", "y", "z"], "box").checkpoint()
    leaves = spatial._start_levels(places, 3, 64).withColumns(spatial._Grid(3).cells(2.0 ** F.col("lvl"))).checkpoint()
    far = places.where("p0 > 41")
    met = spatial._leaves_in_reach(far, spatial._pyramid(leaves, 3), 3).join(leaves.select("g", "lvl", "c0", "c1", "c2"), ["g", "lvl", "c0", "c1", "c2"])
    counts = {r["p0"]: r["count"] for r in met.groupBy("p0").count().collect()}
    assert set(counts) == {90.0, 41.5} and max(counts.values()) < 1000  # one side of the cluster of 4000
    got = {k: v[0] for k, v in neighbours(spark, rows, 0.1).items()}
    want = brute_force(rows, 0.1)
    assert all(got[k] == pytest.approx(want[k][0], rel=1e-9) for k in want)
