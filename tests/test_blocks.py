"""Training passes work on blocks of rows, not on single ones."""

from __future__ import annotations

import numpy as np
import pytest

from starloom.operators import boosting as B


def test_boosting_keeps_blocks_and_the_rows_of_every_node(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 2))
    x[rng.random(1000) < 0.2, 1] = np.nan
    values = spark.createDataFrame([(float(i % 2), 1.0, r.tolist()) for i, r in enumerate(x)], "y double, w double, x array<double>")
    edges = [np.array([-0.5, 0.0, 0.5])] * 2
    monkeypatch.setattr(B, "BLOCK_ROWS", 300)
    blocks = B.binned_rows(values.coalesce(1), edges, 0.5).collect()
    assert [len(r["y"]) // 8 for r in blocks] == [300, 300, 300, 100]  # 1000 single rows before
    bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(2, -1) for r in blocks], axis=1)
    want = np.where(np.isnan(x), B.MISSING, np.searchsorted(edges[0], x, "left")).T
    assert (bins == want).all() and {float(v) for r in blocks for v in np.frombuffer(r["margin"])} == {0.5}

    # a root split on feature 0, its right side on feature 1 with missing rows on the left
    routes = (np.array([0, -1, 1, -1, -1]), np.array([1, 0, 0, 0, 0]), np.array([False, False, True, False, False]),
              np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]))
    left = bins[0] <= 1
    low = (bins[1] == 0) | (bins[1] == B.MISSING)
    found = {node: set(rows.tolist()) for node, rows in B.reached(routes, bins)}
    assert found == {n: set(np.flatnonzero(m).tolist()) for n, m in {1: left, 3: ~left & low, 4: ~left & ~low}.items()}
    only = {node: len(rows) for node, rows in B.reached(routes, bins, [4])}
    assert only == {4: int((~left & ~low).sum())}


@pytest.mark.parametrize("width", [1, 300])
def test_blocks_of_wide_rows_are_smaller(spark, monkeypatch, width):
    monkeypatch.setattr(B, "BLOCK_BYTES", 6000)
    values = spark.range(50).selectExpr("1.0D AS y", "1.0D AS w", f"array_repeat(double(id), {width}) AS x").coalesce(1)
    sizes = [len(r["bins"]) for r in B.binned_rows(values, [np.array([10.0])] * width, 0.0).collect()]
    assert sum(sizes) == 50 * width and max(sizes) <= 6000
