from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import metrics as M


def frame(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")


def values(spark, y, s, threshold=0.5):
    return M.compute_metrics(frame(spark, y, s), "y", "s", threshold=threshold).first().asDict()


def test_names_and_perfect_ranking(spark):
    got = values(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    assert tuple(got) == M.METRIC_NAMES
    assert set(got.values()) == {1.0}


def test_threshold_moves_recall(spark):
    assert values(spark, [0, 0, 1, 1], [0.1, 0.2, 0.4, 0.4], 0.5)["test_recall"] == 0.0
    assert values(spark, [0, 0, 1, 1], [0.1, 0.2, 0.4, 0.4], 0.3)["test_recall"] == 1.0


def test_genuine_class_uses_label_zero(spark):
    got = values(spark, [0, 0, 0, 1], [0.1, 0.2, 0.9, 0.9])
    assert got["test_recall_genuine"] == pytest.approx(2 / 3)
    assert got["test_precision_genuine"] == 1.0
    assert got["test_precision"] == 0.5


def test_zero_division_is_zero(spark):
    got = values(spark, [1, 1, 0], [0.1, 0.1, 0.2])
    assert got["test_precision"] == got["test_recall"] == got["test_f1"] == 0.0


def reference(y, s):
    """Average precision and ROC area over distinct scores, straight from their definitions."""
    y, s = np.asarray(y), np.asarray(s)
    ap = last = 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = (hit & (y == 1)).sum() / (y == 1).sum()
        ap += (recall - last) * (hit & (y == 1)).sum() / hit.sum()
        last = recall
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    return ap, auc


def test_random_scores_with_ties(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(500) < 0.81).astype(int)
    s = np.round(0.3 * y + rng.random(500), 2)
    got = values(spark, y, s)
    ap, auc = reference(y, s)
    assert got["test_average_precision"] == pytest.approx(ap)
    assert got["test_roc_auc"] == pytest.approx(auc)
    assert all(0.0 <= v <= 1.0 for v in got.values())


def test_single_class(spark):
    got = values(spark, [1, 1], [0.2, 0.9])
    assert got["test_average_precision"] == 1.0 and got["test_roc_auc"] is None
    assert values(spark, [0, 0], [0.2, 0.9])["test_average_precision"] == 0.0


def test_curves_end_at_one(spark):
    out = M.pr_roc_curves(frame(spark, [0, 1, 0, 1], [0.1, 0.2, 0.3, 0.3]), "y", "s").orderBy(F.desc("s")).collect()
    assert [r["recall"] for r in out] == [0.5, 1.0, 1.0]
    assert [r["fpr"] for r in out] == [0.5, 0.5, 1.0]
    assert {r["prevalence"] for r in out} == {0.5}


def test_confusion_matrix_is_complete(spark):
    df = frame(spark, [1, 1, 1], [0.9, 0.8, 0.1]).withColumn("p", M.predicted_class("s"))
    got = {(r["actual"], r["predicted"]): (r["n"], r["row_share"]) for r in M.confusion_matrix(df, "y", "p").collect()}
    assert got == {(0, 0): (0, 0.0), (0, 1): (0, 0.0), (1, 0): (1, pytest.approx(1 / 3)), (1, 1): (2, pytest.approx(2 / 3))}


def test_confusion_matrix_of_threshold_metrics(spark):
    df = frame(spark, [0, 1, 1, 0], [0.9, 0.8, 0.1, 0.2]).withColumn("p", M.predicted_class("s"))
    a = M.threshold_metrics(df, "y", "p").first().asDict()
    b = M.compute_metrics(df, "y", "s").first().asDict()
    assert a == {k: b[k] for k in a}
