"""Fitted tree ensembles as node tables: scoring, pruning and exact contributions.

A node table is as large as the model, not as the data; it travels to the tasks that score rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.session import ensure_checkpoint_dir, importable

LEAF = -1


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first and parents before children.

    A row goes left if its value is at most ``threshold``; a missing one (NaN) if ``missing_left``. ``feature`` is
    ``LEAF`` at leaves. ``value`` is the output of a node, ``cover`` the weight of its training rows, ``risk`` its
    impurity times its share of all weight.
    """

    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    risk: np.ndarray

    KINDS = {"feature": int, "threshold": float, "missing_left": bool, "left": int, "right": int, "value": float,
             "cover": float, "risk": float}

    @classmethod
    def of(cls, columns: dict[str, Sequence]) -> Tree:
        return cls(**{name: np.array(columns[name], kind) for name, kind in cls.KINDS.items()})

    def columns(self) -> dict[str, list]:
        return {name: getattr(self, name).tolist() for name in self.KINDS}

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            feature = self.feature[node]
            inner = feature != LEAF
            if not inner.any():
                return node
            v = x[rows, np.maximum(feature, 0)]
            left = np.where(np.isnan(v), self.missing_left[node], v <= self.threshold[node])
            node = np.where(inner, np.where(left, self.left[node], self.right[node]), node)


def pruned(tree: Tree, alpha: float) -> Tree:
    """The smallest subtree of least risk + alpha * leaves: what weakest-link pruning up to ``alpha`` leaves."""
    n = len(tree.feature)
    cost = tree.risk + alpha
    keep = tree.feature != LEAF
    for i in range(n - 1, -1, -1):
        if keep[i]:
            below = cost[tree.left[i]] + cost[tree.right[i]]
            keep[i] = below < cost[i]
            cost[i] = min(cost[i], below)
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        if keep[i]:
            stack += [int(tree.right[i]), int(tree.left[i])]
    number = {old: new for new, old in enumerate(order)}
    out = {name: [getattr(tree, name)[i] for i in order] for name in Tree.KINDS}
    out["feature"] = [int(tree.feature[i]) if keep[i] else LEAF for i in order]
    for side in ("left", "right"):
        out[side] = [number[int(getattr(tree, side)[i])] if keep[i] else LEAF for i in order]
    return Tree.of(out)


def leaf_paths(tree: Tree) -> list[tuple[int, list[tuple[int, float, float, bool, float]]]]:
    """Every leaf with one entry for each feature on its path: feature, low, high, missing rows pass, and the share of
    the parents' cover that goes on at the steps of this feature."""
    out = []
    stack: list[tuple[int, dict]] = [(0, {})]
    while stack:
        i, path = stack.pop()
        if tree.feature[i] == LEAF:
            out.append((i, [(f, *step) for f, step in sorted(path.items())]))
            continue
        f, at = int(tree.feature[i]), float(tree.threshold[i])
        low, high, missing, share = path.get(f, (-np.inf, np.inf, True, 1.0))
        for child, side in (
            (int(tree.left[i]), (low, min(high, at), missing and bool(tree.missing_left[i]))),
            (int(tree.right[i]), (max(low, at), high, missing and not tree.missing_left[i])),
        ):
            part = tree.cover[child] / tree.cover[i] if tree.cover[i] else 0.5
            stack.append((child, {**path, f: (*side, share * part)}))
    return out


def expected_value(tree: Tree) -> float:
    """Mean output over the training rows: what contributions start from."""
    leaf = tree.feature == LEAF
    return float((tree.value[leaf] * tree.cover[leaf]).sum() / tree.cover[leaf].sum())


def path_contributions(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Exact Shapley values of the tree for each row and feature, absent features following the training cover.

    A leaf of value v whose path has the features U adds to feature j of them
    v (o_j - z_j) * integral over t of prod_{i in U, i != j} (z_i (1 - t) + o_i t),
    with o_i = 1 if the row passes the conditions on i and z_i the share of the cover that does. The integral is that
    over all orders of the features; as a polynomial of degree |U| - 1 it is exact with |U| / 2 quadrature points.
    """
    phi = np.zeros(x.shape)
    for leaf, path in leaf_paths(tree):
        if not path:
            continue
        which = [f for f, *_ in path]
        low, high, missing, share = (np.array(c) for c in list(zip(*path, strict=True))[1:])
        z = np.maximum(share, 1e-300)
        v = x[:, which]
        o = np.where(np.isnan(v), missing, (v > low) & (v <= high)).astype(float)
        at, weight = np.polynomial.legendre.leggauss(len(path) // 2 + 1)
        t, weight = (at + 1) / 2, weight / 2
        factor = z[:, None] * (1 - t) + o[:, :, None] * t
        others = factor.prod(axis=1)[:, None, :] / factor
        phi[:, which] += tree.value[leaf] * (o - z) * (others @ weight)
    return phi


class TreeModel(Model, HasFeaturesCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """A classifier whose raw score is ``base`` plus the sum of the outputs of its trees: a log-odds if ``link`` is
    ``logit``, the probability of class 1 if it is ``mean``. Missing values are NaN or NULL entries."""

    trees = Param(Params._dummy(), "trees", "node tables as JSON", TypeConverters.toString)
    base = Param(Params._dummy(), "base", "score before any tree", TypeConverters.toFloat)
    link = Param(Params._dummy(), "link", "logit or mean", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees: str = "[]", base: float = 0.0, link: str = "logit", featuresCol: str = "features",
                 probabilityCol: str = "probability") -> None:
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(trees="[]", base=0.0, link="logit")

    @classmethod
    def of(cls, trees: Sequence[Tree], base: float, link: str) -> TreeModel:
        return cls(trees=json.dumps([t.columns() for t in trees]), base=float(base), link=link)

    def tables(self) -> list[Tree]:
        return [Tree.of(t) for t in json.loads(self.getOrDefault(self.trees))]

    def raw_score(self, x: Column) -> Column:
        trees, base = self.tables(), self.getOrDefault(self.base)

        @F.pandas_udf("double")
        def score(rows: pd.Series) -> pd.Series:
            values = _matrix(rows)
            return pd.Series(base + sum((t.value[t.leaf_of(values)] for t in trees), np.zeros(len(values))))

        return score(x)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        importable(dataset.sparkSession)
        raw = self.raw_score(vector_to_array(self.getFeaturesCol()))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-raw)) if self.getOrDefault(self.link) == "logit" else raw
        scored = dataset.withColumn("__p", p)
        vector = array_to_vector(F.array(F.lit(1.0) - F.col("__p"), F.col("__p")))
        return scored.withColumn(self.getProbabilityCol(), vector).drop("__p")


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array([np.asarray(r, dtype=np.float64) for r in rows]) if len(rows) else np.zeros((0, 0))


def forest_trees(model: Model) -> list[Tree]:
    """Node tables of a fitted forest of two classes; a leaf's output is its weighted share of class 1."""
    spark = SparkSession.active()
    path = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    by_tree: dict[int, list] = {}
    for r in nodes:
        by_tree.setdefault(r["treeID"], []).append(r)
    out = []
    for _, rows in sorted(by_tree.items()):
        total = sum(rows[0]["impurityStats"]) or 1.0
        stats = [r["impurityStats"] for r in rows]
        inner = [r["leftChild"] >= 0 for r in rows]
        out.append(Tree.of({
            "feature": [r["split"]["featureIndex"] if i else LEAF for r, i in zip(rows, inner, strict=True)],
            "threshold": [r["split"]["leftCategoriesOrThreshold"][0] if i else 0.0 for r, i in zip(rows, inner, strict=True)],
            "missing_left": [False] * len(rows),
            "left": [r["leftChild"] for r in rows], "right": [r["rightChild"] for r in rows],
            "value": [s[1] / sum(s) if sum(s) else 0.0 for s in stats], "cover": [sum(s) for s in stats],
            "risk": [r["impurity"] * sum(s) / total for r, s in zip(rows, stats, strict=True)],
        }))
    return out


def forest_model(trees: Sequence[Tree]) -> TreeModel:
    """Mean of the trees' class shares."""
    share = 1.0 / len(trees)
    return TreeModel.of([Tree(**{**t.__dict__, "value": t.value * share}) for t in trees], 0.0, "mean")


def tree_contributions(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], model: TreeModel, carry: Sequence[str] = ()
) -> DataFrame:
    """Exact contributions of a tree ensemble to its raw score, one row per (row, feature).

    The contributions of a row and ``base_score(model)`` add up to its raw score. Features are columns that may be NULL, in
    the order in which the model was fitted. Every row is explained by itself, so nothing is shuffled.
    """
    importable(df.sparkSession)
    features, keys, carry = list(features), list(keys), list(carry)
    trees = model.tables()

    @F.pandas_udf("array<double>")
    def explained(rows: pd.Series) -> pd.Series:
        values = _matrix(rows)
        total = sum((path_contributions(t, values) for t in trees), np.zeros(values.shape))
        return pd.Series(list(total), dtype=object)

    missing = F.lit(float("nan"))
    own = F.array(*[F.coalesce(F.col(c).cast("double"), missing) for c in features])
    # of columns that are there, so that the explanation is computed once a row
    parts = df.select(*keys, *carry, *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(features)], explained(own).alias("__phi"))
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"__v{i}").alias("value"), F.get("__phi", F.lit(i)).alias("contribution"))
        for i, c in enumerate(features)
    ])
    return parts.select(*keys, *carry, F.inline(rows))


def base_score(model: TreeModel) -> float:
    return model.getOrDefault(model.base) + sum(expected_value(t) for t in model.tables())
