"""Histogram boosting, pruning and exact contributions against plain versions."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from starloom.operators import models as L
from starloom.operators import trees as T
from starloom.operators.boosting import HistogramBoosting, best_split

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    """Label 1 where a is large, or where c is missing and b is small."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(900, 3)), 1)
    x[rng.random(900) < 0.3, 2] = np.nan
    p = np.where(x[:, 0] > 0.5, 0.9, np.where(np.isnan(x[:, 2]) & (x[:, 1] < 0), 0.85, 0.1))
    return x, (rng.random(900) < p).astype(float)


@pytest.fixture(scope="module")
def vectors(spark, data):
    x, y = data
    rows = [(i, *(None if math.isnan(v) else float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label double").withColumn("weight", F.lit(1.0))
    out = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(df)
    return out.repartition(5).cache()


def plain_tree(x, g, h, max_depth, min_leaf, max_leaves):
    """Best-first growth by trying every value of every feature, missing rows on either side."""

    def search(rows, depth):
        best = None
        if max_depth is not None and depth >= max_depth:
            return None
        total = g[rows].sum() ** 2 / h[rows].sum()
        for f in range(x.shape[1]):
            v = x[rows, f]
            for at in np.unique(v[~np.isnan(v)]):
                for missing_left in (False, True):
                    left = np.where(np.isnan(v), missing_left, v <= at)
                    lo, hi = rows[left], rows[~left]
                    if min(len(lo), len(hi)) < min_leaf:
                        continue
                    gain = g[lo].sum() ** 2 / h[lo].sum() + g[hi].sum() ** 2 / h[hi].sum() - total
                    if best is None or gain > best[0] * (1 + 1e-9):
                        best = (gain, lo, hi)
        return best if best and best[0] > 1e-9 else None

    leaves = [(np.arange(len(x)), 0, search(np.arange(len(x)), 0))]
    while len(leaves) < max_leaves:
        i = max(range(len(leaves)), key=lambda i: leaves[i][2][0] if leaves[i][2] else -1)
        rows, depth, best = leaves[i]
        if not best:
            break
        leaves[i : i + 1] = [(part, depth + 1, search(part, depth + 1)) for part in best[1:]]
    return [rows for rows, _, _ in leaves]


@pytest.mark.parametrize(("depth", "leaves", "rounds"), [(None, 7, 3), (2, 31, 2), (None, 2, 10)])
def test_boosting_grows_the_trees_of_a_plain_search(vectors, data, depth, leaves, rounds):
    x, y = data
    model = HistogramBoosting(rounds, depth, 0.3, 20, leaves).fit(vectors)
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for table in model.tables():
        p = 1 / (1 + np.exp(-margin))
        want = plain_tree(x, p - y, p * (1 - p), depth, 20, leaves)
        leaf = table.leaf_of(x)
        assert {frozenset(np.flatnonzero(leaf == n)) for n in np.unique(leaf)} == {frozenset(r) for r in want}
        for rows in want:
            margin[rows] -= 0.3 * (p - y)[rows].sum() / (p * (1 - p))[rows].sum()
    got = {r["id"]: r["score"] for r in L.positive_probability(model, vectors).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-5)


def test_boosting_learns_from_missing_values_and_not_from_the_partitioning(vectors, data):
    x, y = data
    model = HistogramBoosting(9, None, 0.4, 20, 6).fit(vectors)
    again = HistogramBoosting(9, None, 0.4, 20, 6).fit(vectors.repartition(2, "id"))
    assert model.getOrDefault(model.trees) == again.getOrDefault(again.trees)
    p = np.array([r["score"] for r in L.positive_probability(model, vectors).orderBy("id").collect()])
    hidden = np.isnan(x[:, 2]) & (x[:, 1] < 0) & (x[:, 0] <= 0.5)
    assert p[hidden].mean() > 0.6 and p[~hidden & (x[:, 0] <= 0.5)].mean() < 0.25


def test_one_class_and_missing_features(spark):
    rows = [(float(i % 3), None, 1.0, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, label double, weight double")
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(df)
    model = HistogramBoosting(3).fit(vec)
    assert {r["score"] for r in L.positive_probability(model, vec).collect()} == {1.0}
    mixed = vec.withColumn("label", (F.col("a") > 0).cast("double"))
    scores = {(r["a"], round(r["score"], 3)) for r in L.positive_probability(HistogramBoosting(2, min_samples_leaf=5).fit(mixed), mixed).collect()}
    assert len(scores) == 3 and min(scores)[1] < 0.67 < max(scores)[1]
    with pytest.raises(ValueError, match="no rows"):
        HistogramBoosting(3).fit(vec.where("false"))


def test_later_missing_values_follow_the_larger_side():
    hist = np.zeros((1, 256, 3), np.int64)
    hist[0, 0], hist[0, 1] = (-(10 << 24), 10 << 24, 40), (30 << 24, 10 << 24, 60)
    split = best_split(hist, 20)
    assert (split.feature, split.bin, split.missing_left) == (0, 0, False)
    hist[0, MISSING_BIN] = (10 << 24, 10 << 24, 20)
    assert best_split(hist, 20).missing_left is False
    hist[0, MISSING_BIN] = (-(10 << 24), 10 << 24, 20)
    assert best_split(hist, 20).missing_left is True


MISSING_BIN = 255


def conditional_score(tree, x, known, node=0):
    """Expected output if only the known features of a row are, others following the cover."""
    f = int(tree.feature[node])
    if f == T.LEAF:
        return tree.value[node]
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        goes_left = tree.missing_left[node] if math.isnan(x[f]) else x[f] <= tree.threshold[node]
        return conditional_score(tree, x, known, left if goes_left else right)
    share = tree.cover[left] / tree.cover[node]
    return share * conditional_score(tree, x, known, left) + (1 - share) * conditional_score(tree, x, known, right)


def shapley(tree, x):
    n = len(x)
    phi = np.zeros(n)
    for j in range(n):
        rest = [i for i in range(n) if i != j]
        for m in range(n):
            for s in itertools.combinations(rest, m):
                weight = math.factorial(m) * math.factorial(n - m - 1) / math.factorial(n)
                phi[j] += weight * (conditional_score(tree, x, {*s, j}) - conditional_score(tree, x, set(s)))
    return phi


def test_contributions_are_the_shapley_values_of_all_subsets(vectors, data):
    x, _ = data
    model = HistogramBoosting(3, None, 0.3, 20, 12).fit(vectors)
    out = T.tree_contributions(vectors.where("id < 25"), ["id"], FEATURES, model).collect()
    got = {(r["id"], r["feature"]): r["contribution"] for r in out}
    for i in range(25):
        want = sum(shapley(t, x[i]) for t in model.tables())
        assert [got[i, f] for f in FEATURES] == pytest.approx(want, abs=1e-9)
        raw = model.getOrDefault(model.base) + sum(t.value[t.leaf_of(x[i : i + 1])][0] for t in model.tables())
        assert T.base_score(model) + sum(want) == pytest.approx(raw)
    assert all(r["value"] is None for r in out if r["feature"] == "c" and math.isnan(x[r["id"], 2]))


def hand_tree():
    """Root, an inner left child with two leaves, and a right leaf; risks are shares of all rows."""
    return T.Tree.of({
        "feature": [0, 1, -1, -1, -1], "threshold": [0.0, 0.0, 0.0, 0.0, 0.0], "missing_left": [False] * 5, "left": [1, 2, -1, -1, -1],
        "right": [4, 3, -1, -1, -1], "value": [0.5, 0.3, 0.1, 0.6, 0.9], "cover": [10.0, 6.0, 3.0, 3.0, 4.0],
        "risk": [0.5, 0.20, 0.05, 0.10, 0.05],
    })


def test_pruning_takes_the_weakest_link_first():
    """The inner child goes at 0.20 - 0.15 = 0.05, the root at (0.5 - 0.25) / 1 = 0.25 after that."""
    leaves = {a: int((T.pruned(hand_tree(), a).feature == T.LEAF).sum()) for a in (0.0, 0.049, 0.051, 0.249, 0.251)}
    assert leaves == {0.0: 3, 0.049: 3, 0.051: 2, 0.249: 2, 0.251: 1}
    two = T.pruned(hand_tree(), 0.1)
    assert two.value.tolist() == [0.5, 0.3, 0.9] and two.left.tolist() == [1, -1, -1] and two.right.tolist() == [2, -1, -1]


def test_pruned_forest_is_smaller_and_the_unpruned_table_is_the_forest(vectors, data):
    x, _ = data
    filled = vectors.fillna(0.0, ["c"]).drop("features")
    filled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(filled).select("id", "label", "features").cache()
    params = {"n_estimators": 5, "max_depth": 5, "min_samples_leaf": 5, "max_features": "sqrt", "class_weight": None, "ccp_alpha": 0.0}
    plain = L.fit_prepared("rf", filled, params)
    same = L.as_trees(plain)
    score = lambda m: np.array([r["score"] for r in L.positive_probability(m, filled).orderBy("id").collect()])
    assert score(same) == pytest.approx(score(plain), abs=1e-12)
    small = L.fit_prepared("rf", filled, {**params, "ccp_alpha": 0.01})
    count = lambda m: sum(len(t.feature) for t in m.tables())
    assert 5 <= count(small) < count(same)
    balanced = score(L.fit_prepared("rf", filled, {**params, "class_weight": "balanced"}))
    per_tree = score(L.fit_prepared("rf", filled, {**params, "class_weight": "balanced_subsample"}))
    assert not np.allclose(balanced, per_tree) and np.corrcoef(balanced, per_tree)[0, 1] > 0.8


def test_bootstrap_draws_are_poisson(spark):
    df = spark.range(20_000).select(F.array(F.col("id").cast("double")).alias("v"), F.lit(1.0).alias("label"))
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector("v").alias("features"), "label").select(L.bootstrap_draws(1).alias("a"), L.bootstrap_draws(2).alias("b"))
    got = rows.agg(F.avg("a"), F.variance("a"), F.corr("a", "b"), F.avg((F.col("a") == 0).cast("int"))).first()
    assert list(got) == pytest.approx([1.0, 1.0, 0.0, math.exp(-1)], abs=0.04)


def test_saved_tree_model_scores_alike(spark, vectors, tmp_path):
    model = L.PipelineModel([HistogramBoosting(2, None, 0.3, 20, 4).fit(vectors)])
    L.save_model(model, str(tmp_path / "m"))
    before, after = (
        [r["score"] for r in L.positive_probability(m, vectors).orderBy("id").collect()] for m in (model, L.load_model(str(tmp_path / "m")))
    )
    assert before == after
