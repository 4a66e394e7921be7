from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One group and one value hold a third of the rows."""
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(700, 5.0), rng.integers(0, 400, 1300) / 7.0])
    groups = np.where(rng.random(2000) < 0.7, "hot", rng.choice(["a", "b", "c"], 2000))
    frame = pd.DataFrame({"g": groups, "v": values, "w": rng.integers(1, 5, 2000)})
    frame.loc[::97, "v"] = np.nan
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(skewed, descending):
    frame, df = skewed
    got = ordered.running_totals(df, "v", {"s": F.col("w")}, ["g"], descending).toPandas()
    want = frame.dropna().groupby(["g", "v"])["w"].sum().reset_index(name="s")
    want = want.sort_values("v", ascending=not descending)
    want["cum_s"] = want.groupby("g")["s"].cumsum()
    key = ["g", "v"]
    pd.testing.assert_frame_equal(
        got.sort_values(key)[[*key, "s", "cum_s"]].reset_index(drop=True),
        want.sort_values(key).reset_index(drop=True),
        check_dtype=False,
    )


def test_running_totals_with_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0)], "g string, v double")
    got = {(r["g"], r["v"]): r["cum_n"] for r in ordered.running_totals(df, "v", {"n": F.lit(1)}, ["g"]).collect()}
    assert got == {(None, 1.0): 1, (None, 2.0): 2, ("a", 1.0): 1}


def test_distribution_curve_ends_at_one(skewed):
    _, df = skewed
    top = ordered.distribution_curve(df, "v", ["g"]).groupBy("g").agg(F.max("fraction").alias("f")).collect()
    assert [r["f"] for r in top] == [1.0] * 4


def test_exact_quantiles(skewed):
    frame, df = skewed
    got = ordered.exact_quantiles(df, "v", {"a": 0.0, "b": 0.37, "c": 1.0}, ["g"]).toPandas().set_index("g")
    want = frame.dropna().groupby("g")["v"].quantile([0.0, 0.37, 1.0]).unstack()
    for g in want.index:
        assert got.loc[g, ["a", "b", "c"]].to_numpy(float) == pytest.approx(want.loc[g].to_numpy())


def test_quantiles_of_empty_input(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert ordered.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).count() == 0


def test_forward_fill_carries_over_blocks(spark):
    rows = [("f", i // 3, i, i in (1, 7)) for i in range(12)] + [("e", 0, 0, False)]
    df = spark.createDataFrame(rows, "g string, b long, i long, src boolean")
    out = ordered.forward_fill(df, {"at": F.col("i")}, F.col("src"), ["g"], ["i"], ["b"])
    got = {(r["g"], r["i"]): r["at"] for r in out.collect()}
    assert got == {("f", i): None if i < 1 else 1 if i < 7 else 7 for i in range(12)} | {("e", 0): None}


def test_no_window_over_a_whole_group(skewed):
    from conftest import plan_of

    _, df = skewed
    text = plan_of(ordered.running_totals(df, "v", {"n": F.lit(1)}, ["g"]))
    assert "SinglePartition" not in text
    assert "windowspecdefinition(g" in text and ordered.RANGE in text


def test_every_operator_reads_its_source_once(spark, skewed):
    """Rows that pass a counting step, for each operator that needs several looks at the ordered values."""
    from starloom.operators import distributions, metrics

    frame, df = skewed
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    source = df.withColumn("y", (F.col("w") > 2).cast("int")).mapInPandas(counted, "g string, v double, w long, y int")
    for run in (
        lambda: ordered.running_totals(source, "v", {"s": F.col("w")}, ["g"]),
        lambda: ordered.distribution_curve(source, "v", ["g"]),
        lambda: ordered.exact_quantiles(source, "v", {"m": 0.5}, ["g"]),
        lambda: metrics.pr_roc_curves(source, "y", "v", ["g"]),
        lambda: metrics.compute_metrics(source, "y", "v"),
        lambda: distributions.violin(source, "v", ["g"], 20),
        lambda: distributions.box_plot(source, ["v"], ["g"]),
    ):
        before = read.value
        run().collect()
        assert read.value - before == len(frame)


def test_repeated_values_cost_a_violin_nothing(spark):
    """The densities of a million rows of fifty values are those of fifty weighted ones."""
    from starloom.operators import distributions

    rows = spark.range(200_000).select((F.col("id") % 50).cast("double").alias("v"), F.lit("x").alias("g"))
    few = distributions.violin(rows, "v", ["g"], 10).orderBy("point").collect()
    values, grid = np.repeat(np.arange(50.0), 4000), np.linspace(0, 49, 10)
    bw = values.std(ddof=1) * len(values) ** -0.2
    want = [np.exp(-0.5 * ((g - np.arange(50.0)) / bw) ** 2).sum() * 4000 / (len(values) * bw * np.sqrt(2 * np.pi)) for g in grid]
    assert [r["density"] for r in few] == pytest.approx(want) and {r["median"] for r in few} == {24.5}
