"""The network on blocks of rows against Spark's own training and finite differences."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from starloom.operators import models as L
from starloom.operators import networks as N


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    sizes = [3, 4, 2, 2]
    x, y, c = rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float), rng.integers(1, 4, 7).astype(float)
    w = rng.normal(size=3 * 4 + 4 + 4 * 2 + 2 + 2 * 2 + 2)
    _, slope = N.loss_and_gradient(w, sizes, y, c, x)
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        two = [N.loss_and_gradient(w + s, sizes, y, c, x)[0] for s in (step, -step)]
        assert slope[i] == pytest.approx((two[0] - two[1]) / 2e-6, abs=1e-6)
    more = np.repeat(np.arange(7), c.astype(int))
    again = N.loss_and_gradient(w, sizes, y[more], np.ones(len(more)), x[more])
    assert again[0] == pytest.approx(N.loss_and_gradient(w, sizes, y, c, x)[0]) and again[1] == pytest.approx(slope)


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(640, 2))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=640) > 0.4).astype(float)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))],
                               "id long, a double, b double, label double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).coalesce(1).cache()


@pytest.mark.parametrize("iterations", [1, 10])
def test_training_is_that_of_spark(train, iterations):
    """640 rows are five whole stacks of Spark's, so both objectives are the same mean."""
    spark_model = L.network(2, iterations).fit(train)
    blocks = N.blocks_of(train.withColumn(L.COPIES, F.lit(1)), "label", "features", L.COPIES)
    ours = L.resumed(blocks, 2, iterations, None)
    assert ours.weights.toArray() == pytest.approx(spark_model.weights.toArray(), rel=1e-4, abs=1e-5)


def test_a_row_with_copies_is_worked_on_once(train, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 200)
    counted = L.with_copies(train.drop("features"), ["id"])
    n = L.oversampled(train, ["id"]).count()
    with L.network_blocks(counted, ["a", "b"]) as (prep, blocks):
        held = blocks.collect()
        assert sum(len(r["y"]) // 8 for r in held) == 640 and max(len(r["y"]) // 8 for r in held) <= 200  # n rows before
        assert sum(np.frombuffer(bytes(r["c"])).sum() for r in held) == n > 640
        mean = L.oversampled(train, ["id"]).agg(F.avg("a"), F.stddev("a")).first()
        assert (prep.stages[-1].mean[0], prep.stages[-1].std[0]) == pytest.approx(tuple(mean))


def test_a_resumed_fit_works_no_point_out_twice(train, monkeypatch):
    blocks = N.blocks_of(train.withColumn(L.COPIES, F.lit(1)), "label", "features", L.COPIES).cache()
    apart = None
    for _ in range(2):
        apart = L.resumed(blocks, 2, 3, apart)
    asked, jobs = [], []
    objective = L.objective

    def counted(*args):
        evaluate = objective(*args)
        return lambda w: asked.append(w.copy()) or evaluate(w)

    collect = type(blocks).collect
    monkeypatch.setattr(L, "objective", counted)
    monkeypatch.setattr(type(blocks), "collect", lambda df: jobs.append(df.columns) or collect(df))
    together = L.fit_network(blocks, 2, 6, 3)
    assert together.weights.toArray().tolist() == apart.weights.toArray().tolist()
    assert jobs.count(["part", "loss", "n", "gradient"]) == len(asked) - 1  # as many as asked before


@pytest.mark.parametrize("rows, partitions, tasks", [(1_790_000, 24, 24), (10_700_000, 200, 200), (250_000, 24, 3), (10**9, 5000, 1000), (0, 0, 1)])
def test_tasks_hold_equally_many_partitions(rows, partitions, tasks):
    assert L.even_tasks(rows, partitions) == tasks  # 18 of 24 before: some held two, the others one
