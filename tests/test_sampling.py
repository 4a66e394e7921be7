from __future__ import annotations

import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from starloom.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1003).select("id", (F.col("id") % 5 != 0).alias("y"), F.when(F.col("id") < 700, "a").otherwise("b").alias("pop"))


def counts(df, *columns):
    return {tuple(r)[:-1]: r["count"] for r in df.groupBy(*columns).count().collect()}


def test_three_way_sizes_and_balance(rows):
    out = sampling.stratified_three_way(rows, "y", ["id"], 7, 0.6, 0.2)
    n = 1003
    test = math.ceil(0.2 * n)
    val = math.ceil(0.25 * (n - test))
    got = counts(out, "split_role")
    assert got == {("test",): test, ("val",): val, ("train",): n - test - val}
    both = counts(out, "split_role", "y")
    for role in ("train", "val", "test"):
        share = both[(role, True)] / (both[(role, True)] + both[(role, False)])
        assert share == pytest.approx(802 / 1003, abs=0.01)
    assert out.select("id").distinct().count() == n


def test_three_way_is_independent_of_partitioning(rows):
    a = sampling.stratified_three_way(rows.repartition(3), "y", ["id"], 7, 0.6, 0.2)
    b = sampling.stratified_three_way(rows.repartition(11), "y", ["id"], 7, 0.6, 0.2)
    assert a.exceptAll(b).count() == 0
    other = sampling.stratified_three_way(rows, "y", ["id"], 8, 0.6, 0.2)
    assert a.exceptAll(other).count() > 0


def test_cross_population(rows):
    out = sampling.cross_population_split(rows, "pop", ["a"], ["b"], "y", ["id"], 7, 0.2)
    assert counts(out, "pop", "split_role") == {("a", "val"): 140, ("a", "train"): 560, ("b", "test"): 303}


def test_cross_population_rejects_overlap(rows):
    with pytest.raises(ValueError, match="two roles"):
        sampling.cross_population_split(rows, "pop", ["a"], ["a", "b"], "y", ["id"], 7, 0.2)


def quotas(spark, counts, wanted):
    kind = {bool: "boolean", int: "long"}.get(type(next(iter(counts))), "string")
    classes = spark.createDataFrame(list(counts.items()), f"y {kind}, n long")
    out = sampling.largest_remainder(classes, "y", "n", wanted, sum(counts.values()), "q")
    return {r["y"]: r["q"] for r in out.collect()}


def test_largest_remainder(spark):
    assert quotas(spark, {"a": 5, "b": 3, "c": 2}, 4) == {"a": 2, "b": 1, "c": 1}
    assert sum(quotas(spark, {True: 811, False: 192}, 201).values()) == 201
    assert quotas(spark, {"a": 3}, 0) == {"a": 0}
    assert quotas(spark, {"b": 1, "c": 1, None: 1, "a": 1}, 2) == {None: 1, "a": 1, "b": 0, "c": 0}
    assert quotas(spark, {"a": 10**18, "b": 2 * 10**18}, 10**18) == {"a": 333333333333333333, "b": 666666666666666667}


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.integers(0, 9), st.integers(1, 10**9), min_size=1), st.floats(0, 1))
def test_largest_remainder_is_proportional(spark, counts, share):
    total = sum(counts.values())
    wanted = int(share * total)
    got = quotas(spark, counts, wanted)
    assert sum(got.values()) == wanted
    assert all(wanted * n // total <= got[k] <= min(n, -(-wanted * n // total)) for k, n in counts.items())


def test_stratified_sample(rows):
    out = sampling.stratified_sample(rows, "y", ["id"], 100, 42)
    assert counts(out, "y") == {(True,): 80, (False,): 20}
    assert sampling.stratified_sample(rows, "y", ["id"], 5000, 42).count() == 1003


def test_fixed_size_sample(rows):
    small = rows.where(F.col("y"))
    assert sampling.fixed_size_sample(small, ["id"], 200, 42).count() == 200
    assert sampling.fixed_size_sample(small, ["id"], 5000, 42).count() == 802
    assert sampling.fixed_size_sample(small, ["id"], 200, 42).where(~F.col("y")).count() == 0


def test_class_may_be_null_or_absent(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "x") for i in range(60)], "id long, y string")
    out = sampling.stratified_two_way(df, "y", ["id"], 1, 0.2)
    assert counts(out, "y", "split_role") == {
        (None, "val"): 4, (None, "train"): 16, ("x", "val"): 8, ("x", "train"): 32,
    }


def test_thresholds_are_refined_to_the_wanted_rank(spark, rows):
    hashed = sampling.HashedClasses.of(rows, "y", ["id"], 3)
    ranks = hashed.classes.withColumns({"a": F.lit(1), "b": F.col("__n") - 40, "c": F.lit(0)})
    want = {}
    for y in (True, False):
        order = sorted(hashlib.md5(f"3|{i}".encode()).hexdigest() for i in range(1003) if (i % 5 != 0) == y)
        want[y] = (order[0], order[len(order) - 41], None)
    for bucket_rows in (0, 1, 100_000):
        got = hashed.thresholds(ranks, ["a", "b", "c"], bucket_rows).collect()
        assert {r["y"]: tuple(v and v.hex() for v in (r["a"], r["b"], r["c"])) for r in got} == want


def test_every_row_may_be_a_class(spark):
    df = spark.range(30_000).select("id", F.concat(F.lit("k"), "id").alias("y"))
    out = sampling.stratified_three_way(df, "y", ["id"], 7, 0.6, 0.2)
    assert counts(out, "split_role") == {("test",): 6000, ("val",): 6000, ("train",): 18000}


def test_copies_of_a_key_on_both_sides_raise(spark):
    df = spark.createDataFrame([(1, "x")] * 10, "id long, y string")
    with pytest.raises(PySparkException, match="not unique"):
        sampling.stratified_two_way(df, "y", ["id"], 1, 0.5).collect()


def test_an_empty_table_has_no_roles(spark, rows):
    none = rows.where("id < 0")
    assert not sampling.stratified_three_way(none, "y", ["id"], 7, 0.6, 0.2).collect()
    assert not sampling.stratified_sample(none, "y", ["id"], 10, 7).collect()
