from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import models as L
from starloom.plans.training import train_split

FEATURES, NULLABLE = ["a", "b", "c"], ["c"]


@pytest.fixture(scope="module")
def rows(spark):
    """A nearly separable target; one feature is missing for a third of the rows."""
    rng = np.random.default_rng(2)
    data = []
    for i in range(600):
        y = int(rng.random() < 0.75)
        c = None if i % 3 == 0 else float(rng.normal(y, 1.0))
        role = "train" if i % 5 < 3 else "val" if i % 5 == 3 else "test"
        data.append((i, float(rng.normal(3.0 * y, 1.0)), float(rng.normal()), c, float(y), role))
    df = spark.createDataFrame(data, "id long, a double, b double, c double, label double, split_role string")
    return df.cache()


GRIDS = {
    "lr": {"C": [0.01, 1.0], "l1_ratio": [0.0], "class_weight": [None, "balanced"]},
    "rf": {"n_estimators": [3], "max_depth": [None], "min_samples_leaf": [5], "max_features": ["sqrt", 0.5],
           "class_weight": ["balanced_subsample"], "ccp_alpha": [0.0]},
    "gbm": {"max_iter": [5], "max_depth": [3], "learning_rate": [0.1], "min_samples_leaf": [20], "class_weight": [None]},
}


def test_grid_sizes():
    assert {k: len(L.grid_points(g)) for k, g in L.GRIDS.items()} == {"lr": 50, "rf": 486, "gbm": 72}


def test_sweep_logs_and_saves(spark, rows, tmp_path):
    from starloom.sources.runs import generalisation_table
    from starloom.sources.tables import reset_layers

    reset_layers(spark, ["t_sweep"])
    out = train_split(
        rows, "s1", columns=FEATURES, nullable=NULLABLE, key=["id"], grids=GRIDS, iterations={"max_iterations": 30, "every": 10, "patience": 1},
        runs_table="t_sweep.log", model_dir=str(tmp_path), parallelism=2,
    )
    assert set(out) == {"lr", "rf", "gbm", "ensemble", "mlp_impute", "mlp_mask"}
    assert all(metrics["test_roc_auc"] > 0.9 for _, metrics in out.values())
    assert out["mlp_mask"][0]["input_dim"] == 4 and out["mlp_impute"][0]["input_dim"] == 3
    assert generalisation_table(spark.table("t_sweep.log")).count() == 6
    loaded = L.load_model(str(tmp_path / "lr_s1"))
    scored = L.positive_probability(loaded, rows.where("split_role = 'test'"))
    assert L.test_metrics(scored)["test_roc_auc"] == pytest.approx(out["lr"][1]["test_roc_auc"])


def test_ensemble_needs_all_three(rows):
    out = train_split(rows, "s1", ["lr"], [], columns=FEATURES, nullable=NULLABLE, key=["id"], grids=GRIDS)
    assert set(out) == {"lr"}


def test_tuning_keeps_the_best_point(rows):
    fitted = L.tune("lr", L.Roles.of(rows), FEATURES, GRIDS["lr"])
    assert len(fitted.history) == 4
    assert dict(fitted.params) == max(fitted.history, key=lambda h: h[1])[0]


def test_unknown_names_raise():
    with pytest.raises(ValueError, match="unknown name"):
        L.select_names("svm", list(L.BUILDERS))
    assert L.select_names("all", ["x", "y"]) == ["x", "y"]


def test_missing_model_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        L.load_model(str(tmp_path / "none"))


def test_imputer_sees_only_the_training_rows(rows):
    from pyspark.ml import Pipeline

    train = rows.where("split_role = 'train'")
    fitted = Pipeline(stages=L.imputing_stages(FEATURES, scale=False)).fit(train)
    mean = train.agg(F.avg("c")).first()[0]
    filled = fitted.transform(rows.where("c is null and split_role = 'test'")).select("c__filled").distinct().collect()
    assert [r[0] for r in filled] == [pytest.approx(mean)]


def test_mask_variant_zero_fills(rows):
    out, columns = L.network_inputs(rows, FEATURES, NULLABLE, mask=True)
    assert columns == ["a", "b", "c", "c_missing"]
    assert {(r["c"], r["c_missing"]) for r in out.where("id % 3 = 0").collect()} == {(0.0, 1.0)}


def test_oversampling_balances_without_losing_rows(rows):
    out = L.oversampled(rows, ["id"])
    sizes = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert sizes[0.0] == pytest.approx(sizes[1.0], rel=0.1)
    assert out.select("id").distinct().count() == 600


def test_logistic_penalty_matches_its_definition(spark):
    """With regParam = 1 / (C * n) the gradient of C * loss + |w|^2 / 2 vanishes at the fitted weights."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, label double")
    model = L.fit_one("lr", df, ["a", "b"], {"C": 0.5, "l1_ratio": 0.0})
    w, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    p = 1 / (1 + np.exp(-(z @ w + b)))
    assert 0.5 * z.T @ (p - y) + w == pytest.approx(np.zeros(2), abs=0.2)


def test_soft_vote_is_the_mean(rows):
    train = rows.where("split_role = 'train'")
    a = L.fit_one("lr", train, FEATURES, {"C": 1.0, "l1_ratio": 0.0})
    b = L.fit_one("lr", train, FEATURES, {"C": 0.001, "l1_ratio": 0.0})
    test = rows.where("split_role = 'test'").select("id", *FEATURES)
    mean = L.soft_vote({"a": a, "b": b}, test).select("id", "score")
    both = L.positive_probability(a, test, "pa").join(L.positive_probability(b, test, "pb").select("id", "pb"), "id")
    worst = mean.join(both, "id").agg(F.max(F.abs(F.col("score") - (F.col("pa") + F.col("pb")) / 2))).first()[0]
    assert worst < 1e-12
