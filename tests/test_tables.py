"""Profiles, distributions and table rules on small inputs, including hot groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from starloom.operators import distributions as D
from starloom.operators import profile, quality


def test_maximum_falls_out_of_the_rate_bins(spark):
    df = spark.createDataFrame([(float(i), i % 2 == 0) for i in range(12)], "v double, f boolean")
    out = profile.rate_per_bin(df, "v", "f", 11)
    assert {r["bin"]: r["n"] for r in out.collect()} == {i: 1 for i in range(11)}


def test_error_rates_of_thin_bins_are_null(spark):
    rows = [(8.6, 1, 0)] * 4 + [(9.0, 1, 0)] * 3 + [(9.0, 1, 1)] * 3 + [(12.0, 0, 1)] * 9
    df = spark.createDataFrame(rows, "v double, y int, p int")
    out = {r["bin"]: (r["n"], r["fn_rate"], r["fp_rate"]) for r in profile.binned_error_rates(df, "v", "y", "p", 8.5, 12.0, 15).collect()}
    assert out == {0: (4, None, None), 2: (6, 0.5, None)}


def test_percent_over_an_empty_kind_is_null(spark):
    df = spark.createDataFrame([("c", "C", None), ("w", "W", True), ("w", "W", False)], "g string, k string, y boolean")
    out = {r["g"]: r["pct_positive"] for r in profile.population_summary(df, ["g"], "y", "k", {"W": "n_w", "C": "n_c"}, "W").collect()}
    assert out == {"c": None, "w": 50.0}


def test_null_profile_scans_once(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert plan_of(profile.null_profile(df, ["lang", "source", "n_chars"])).count("FileScan") == 1


def test_type_profile(spark):
    df = spark.createDataFrame([(1, 2, "x")], "a long, b long, c string")
    assert [tuple(r) for r in profile.type_profile(df).collect()] == [("bigint", 2), ("string", 1)]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 2.0, 2.0, 2.5)], "v double")
    assert {r["bin"]: r["n"] for r in D.histogram(df, "v", 4, 0.0, 2.0).collect()} == {0: 1, 1: 1, 2: 1, 3: 2}
    dense = D.histogram(df, "v", 4, 0.0, 2.0, density=True)
    assert dense.agg(F.sum("density") * 0.5).first()[0] == pytest.approx(1.0)


def test_whole_numbers_fall_right_of_their_edge(spark):
    """Counts on edges 0, 1, .. 50, as numpy bins them; 29 / 50 * 50 is below 29 in doubles."""
    df = spark.createDataFrame([(float(v),) for v in range(51)], "v double")
    got = {r["bin"]: r["n"] for r in D.histogram(df, "v", 50, 0.0, 50.0).collect()}
    want, _ = np.histogram(np.arange(51.0), bins=np.arange(0, 51))
    assert got == dict(enumerate(want))


def test_bins_agree_with_numpy_on_and_next_to_edges(spark):
    edges = np.linspace(8.1, 13.5, 70)
    values = np.concatenate([edges, np.nextafter(edges, 0), np.nextafter(edges, 20)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["bin"]: r["n"] for r in D.histogram(df, "v", 69, 8.1, 13.5).collect()}
    want, _ = np.histogram(values, bins=edges)
    assert got == {i: n for i, n in enumerate(want) if n}


def test_box_plot_against_pandas(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"g": np.where(rng.random(900) < 0.9, "hot", "cold"), "v": rng.standard_t(2, 900)})
    out = D.box_plot(spark.createDataFrame(frame), ["v"], ["g"]).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        q1, med, q3 = part["v"].quantile([0.25, 0.5, 0.75])
        inside = part["v"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        row = out.loc[g]
        assert row[["q1", "median", "q3"]].to_numpy(float) == pytest.approx([q1, med, q3])
        assert (row["whisker_low"], row["whisker_high"]) == (part["v"][inside].min(), part["v"][inside].max())
        assert row["n_outliers"] == (~inside).sum()


def test_violin_against_numpy(spark):
    values = np.random.default_rng(6).normal(size=200)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    out = D.violin(df, "v", [], points=50).orderBy("point").toPandas()
    bw = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 50)
    want = np.exp(-0.5 * ((grid[:, None] - values) / bw) ** 2).sum(1) / (len(values) * bw * np.sqrt(2 * np.pi))
    assert out["density"].to_numpy() == pytest.approx(want)


def reflected_smooth(h, sigma):
    """Separable Gaussian smoothing with mirrored borders, in numpy."""
    taps = D.gaussian_taps(sigma)
    r = len(taps) // 2
    for axis in (0, 1):
        padded = np.pad(h, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        h = sum(w * np.take(padded, np.arange(h.shape[axis]) + r + k, axis) for k, w in taps)
    return h


def test_density_grid_and_outliers_against_numpy(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=700), rng.exponential(size=700)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    bins = 20
    limits = (x.min(), x.max(), y.min(), y.max())
    h, xe, ye = np.histogram2d(x, y, bins=bins, range=[limits[:2], limits[2:]])
    smooth = reflected_smooth(h, 1.5)
    got = np.zeros((bins, bins))
    for r in D.density_grid(df, "x", "y", bins=bins).collect():
        got[r["bx"], r["by"]] = r["v"]
    assert got == pytest.approx(smooth, abs=1e-12)
    desc = np.sort(smooth.ravel())[::-1]
    level = desc[np.searchsorted(np.cumsum(desc), 0.95 * smooth.sum())]
    grid = D.density_grid(df, "x", "y", bins=bins)
    assert D.containment_levels(grid, {"l": 0.95}).first()["l"] == pytest.approx(level)
    xi = np.clip(np.digitize(x, xe) - 1, 0, bins - 1)
    yi = np.clip(np.digitize(y, ye) - 1, 0, bins - 1)
    flags = {r["id"]: r["is_outlier"] for r in D.outside_contour(df, "x", "y", bins=bins).collect()}
    assert sum(flags[i] != (smooth[xi[i], yi[i]] < level) for i in range(700)) == 0


def test_rules(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 2.0), (2, "z", None)], "id long, k string, v double")
    ref = spark.createDataFrame([("a",), ("b",)], "key string")
    checks = [
        quality.rule_unique(df, ["id"], "unique"),
        quality.rule_holds(df, {"v in (0, 1)": (F.col("v") > 0) & (F.col("v") < 1), "id positive": F.col("id") > 0}),
        quality.rule_references(df, "k", ref, "key", "known key"),
    ]
    assert {(r["rule"], r["n_violations"]) for r in quality.violations(*checks).collect()} == {
        ("unique", 1), ("v in (0, 1)", 2), ("known key", 1),
    }
    with pytest.raises(ValueError, match="known key: 1"):
        quality.assert_no_violations(*checks)


def test_rate_of_an_empty_table(spark):
    got = quality.hit_rate(spark.range(0), F.col("id") > 0).first().asDict()
    assert got == {"n_total": 0, "n_hit": 0, "n_miss": 0, "pct_hit": 0.0}


def test_rates_of_a_written_table_need_no_scan(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"))
    folder = str(tmp_path / "t")
    df.repartition(5).write.parquet(folder)
    rate = quality.written_rate(spark, folder, "v")
    assert "PushedAggregation: [COUNT(*), COUNT(v)]" in plan_of(rate)
    want = quality.hit_rate(df, F.col("v").isNotNull()).first()
    assert rate.first() == want and want["n_hit"] == 250
    assert quality.written_rate(spark, folder, "v", filled=False).first()["n_hit"] == 750
    df.limit(0).write.parquet(str(tmp_path / "none"))
    assert quality.written_rate(spark, str(tmp_path / "none"), "v").first().asDict() == {"n_total": 0, "n_hit": 0, "n_miss": 0, "pct_hit": 0.0}
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_filters_and_columns_reach_the_scan(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    text = plan_of(profile.conditional_counts(lines.where("l_returnflag = 'R'"), ["l_linestatus"], {"big": F.col("l_quantity") > 40}))
    assert "EqualTo(l_returnflag,R)" in text
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_linestatus:string>" in text


NO_JOIN_WITHOUT_KEYS = ["label_counts", "box_plot_events", "pr_roc_curves", "stratified_label_split", "outside_contour", "violin_sizes"]


@pytest.mark.parametrize("name", NO_JOIN_WITHOUT_KEYS)
def test_no_join_without_keys(spark, sf, name):
    from checks.catalogue import QUERIES

    text = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_violin_keeps_groups_without_a_density(spark):
    rows = [("one", 4.0), ("same", 2.0), ("same", 2.0), (None, 1.0), (None, 3.0), (None, 8.0)]
    out = D.violin(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], points=5).collect()
    by = {g: [r for r in out if r["g"] == g] for g in ("one", "same", None)}
    assert [(r["point"], r["x"], r["density"], r["median"]) for r in by["one"] + by["same"]] == [(0, 4.0, None, 4.0), (0, 2.0, None, 2.0)]
    assert len(by[None]) == 5 and {r["median"] for r in by[None]} == {3.0}


def test_limits_of_an_empty_grid(spark):
    assert D.data_limits(spark.createDataFrame([], "x double, y double"), "x", "y") == (0.0, 0.0, 0.0, 0.0)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [tuple(r) for r in D.histogram(df, "v", 5).collect()] == [(2, 2)]
    assert D.histogram(df, "v", 5, density=True).first()["density"] == 5.0
