from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from starloom.operators import explain as E
from starloom.operators.profile import column_means

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, *map(float, rng.normal(size=3)), i % 4 == 0) for i in range(60)]
    return spark.createDataFrame(data, "id long, a double, b double, c double, is_host boolean")


def linear(df):
    v = vector_to_array("features")
    return df.withColumn("score", v[0] * 2.0 - v[1] + 0.5 * v[2])


def product_score(df):
    v = vector_to_array("features")
    return df.withColumn("score", v[0] * v[1] + v[2])


def test_sampled_values_of_a_linear_model_are_exact(spark, rows):
    """With one background row every order gives coef * (x - background)."""
    background = spark.createDataFrame([(0.5, -1.0, 2.0)], "a double, b double, c double")
    out = E.sampled_contributions(rows, background, ["id"], FEATURES, linear, n_orders=3)
    want = {"a": (2.0, 0.5), "b": (-1.0, -1.0), "c": (0.5, 2.0)}
    for r in out.collect():
        coefficient, base = want[r["feature"]]
        assert r["contribution"] == pytest.approx(coefficient * (r["value"] - base))
    assert out.count() == 180


def test_sampled_values_add_up(spark, rows):
    """The contributions of a row sum to its score minus the background's, for any model."""
    background = spark.createDataFrame([(0.5, -1.0, 2.0)], "a double, b double, c double")
    out = E.sampled_contributions(rows, background, ["id"], FEATURES, product_score, n_orders=5, carry=["is_host"])
    sums = {r["id"]: r["s"] for r in out.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    for r in rows.collect():
        assert sums[r["id"]] == pytest.approx(r["a"] * r["b"] + r["c"] - (0.5 * -1.0 + 2.0))


def test_interaction_is_shared_by_paired_orders(spark):
    """x * y against a zero background: each factor gets half of the product."""
    one = spark.createDataFrame([(1, 3.0, 4.0, 0.0)], "id long, a double, b double, c double")
    zero = spark.createDataFrame([(0.0, 0.0, 0.0)], "a double, b double, c double")
    out = E.sampled_contributions(one, zero, ["id"], FEATURES, product_score, n_orders=2)
    assert {r["feature"]: r["contribution"] for r in out.collect()} == {"a": 6.0, "b": 6.0, "c": 0.0}


def test_background_is_bounded(spark, rows):
    with pytest.raises(ValueError, match="background"):
        E.sampled_contributions(rows, rows, ["id"], FEATURES, linear, max_background=10)


@pytest.fixture(scope="module")
def contributions(rows):
    means = column_means(rows, FEATURES)
    return E.linear_contributions(rows, ["id", "is_host"], {"a": 2.0, "b": -1.0, "c": 0.1}, means)


def test_linear_contributions_have_zero_mean(contributions):
    for r in contributions.groupBy("feature").agg(F.avg("contribution").alias("m")).collect():
        assert r["m"] == pytest.approx(0.0, abs=1e-12)


def test_importance_is_normalised_and_ranked(contributions):
    out = E.ranked(E.importance(contributions)).orderBy("rank").collect()
    assert [r["feature"] for r in out] == ["a", "b", "c"]
    assert sum(r["importance"] for r in out) == pytest.approx(1.0)
    assert [r["feature"] for r in E.top_features(E.importance(contributions), 2).collect()] == ["a", "b"]


def test_dependence_uses_the_best_other_feature(contributions):
    out = E.dependence_points(contributions, ["id"], k=2)
    assert {(r["feature"], r["colour_feature"]) for r in out.collect()} == {("a", "b"), ("b", "a")}
    assert out.count() == 120


def test_flag_importance(contributions):
    out = {r["feature"]: r for r in E.flag_importance(contributions, "is_host").collect()}
    assert sum(r["host"] for r in out.values()) == pytest.approx(1.0)
    assert all(r["difference"] == pytest.approx(r["host"] - r["sub"]) for r in out.values())
