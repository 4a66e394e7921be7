"""Feature preparation, classifiers, selection on a validation role, and scoring with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import missing_flag, stable_hash
from starloom.operators.boosting import HistogramBoosting
from starloom.operators.metrics import METRIC_NAMES, compute_metrics, ranking_metrics
from starloom.operators.networks import MAX_TASKS, TASK_ROWS, Evaluate, blocks_of, minimised, objective
from starloom.operators.trees import Tree, TreeModel, forest_model, forest_trees, pruned

# Model seed, grids and network layout.
MODEL_SEED = 55667788
GRIDS: dict[str, dict[str, list]] = {
    "lr": {
        "C": [0.01, 0.1, 1.0, 10.0, 100.0],
        "l1_ratio": [0.0, 0.1, 0.5, 0.9, 1.0],
        "class_weight": [None, "balanced"],
    },
    "rf": {
        "n_estimators": [200, 500, 1000],
        "max_depth": [None, 10, 20],
        "min_samples_leaf": [1, 5, 20],
        "max_features": ["sqrt", 0.5],
        "class_weight": [None, "balanced", "balanced_subsample"],
        "ccp_alpha": [0.0, 0.001, 0.01],
    },
    "gbm": {
        "max_iter": [100, 300],
        "max_depth": [None, 5, 10],
        "learning_rate": [0.05, 0.1, 0.2],
        "min_samples_leaf": [20, 50],
        "class_weight": [None, "balanced"],
    },
}
HIDDEN_LAYERS = [64, 32, 16]
NETWORKS = {"mlp_impute": False, "mlp_mask": True}
# Iterations of the network: at most, between two looks at the validation loss, and looks without a better one.
MAX_ITERATIONS = 400
CHECK_EVERY = 10
PATIENCE = 5
# Spark trees stop at depth 30, so an unlimited depth becomes 30.
UNLIMITED_FOREST_DEPTH = 30

#: Fitted models that are held to be scored by the same jobs.
SCORED_TOGETHER = 64

LABEL, WEIGHT, VECTOR, COPIES = "label", "weight", "features", "__copies"


def prepared(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric features and a 0/1 double label; NULL stays NULL until the imputer."""
    return df.select(
        *keep,
        *[F.col(c).cast("double").alias(c) for c in features],
        F.col(label).cast("double").alias(LABEL),
    )


def with_missing_flags(df: DataFrame, nullable: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Zero fill of all features plus one missing indicator per nullable feature."""
    flagged = df.withColumns({f"{c}_missing": missing_flag(c) for c in nullable})
    return flagged.fillna(0.0, subset=list(features))


def with_class_weight(df: DataFrame, mode: str | None) -> DataFrame:
    """Weight 1, or n / (2 * n_class) from one two-row count."""
    return _weighted(df, mode, class_sizes(df) if mode else {})


def class_sizes(df: DataFrame) -> dict[float, int]:
    return {r[LABEL]: r["count"] for r in df.groupBy(LABEL).count().collect()}


def _weighted(df: DataFrame, mode: str | None, sizes: dict[float, int]) -> DataFrame:
    if mode is None:
        return df.withColumn(WEIGHT, F.lit(1.0))
    n = sum(sizes.values())
    weight = F.lit(1.0)
    for value, count in sizes.items():
        weight = F.when(F.col(LABEL) == value, F.lit(n / (2.0 * count))).otherwise(weight)
    return df.withColumn(WEIGHT, weight)


def imputing_stages(features: Sequence[str], scale: bool) -> list:
    """Mean imputation fitted on the rows given to ``fit``, assembly and optional standardisation."""
    filled = [f"{c}__filled" for c in features]
    stages: list = [
        Imputer(strategy="mean", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="__raw" if scale else VECTOR, handleInvalid="error"),
    ]
    if scale:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol="__raw", outputCol=VECTOR))
    return stages


def logistic_regression(params: dict, n_rows: int) -> LogisticRegression:
    """Elastic-net logistic regression; C is the inverse total penalty, so regParam = 1 / (C * n)."""
    return LogisticRegression(
        featuresCol=VECTOR, labelCol=LABEL, weightCol=WEIGHT, maxIter=2000, standardization=False,
        regParam=1.0 / (params["C"] * n_rows), elasticNetParam=params["l1_ratio"],
    )


def random_forest(params: dict, n_rows: int) -> RandomForestClassifier:
    share = params["max_features"]
    return RandomForestClassifier(
        featuresCol=VECTOR, labelCol=LABEL, weightCol=WEIGHT, seed=MODEL_SEED,
        numTrees=params["n_estimators"],
        maxDepth=params["max_depth"] or UNLIMITED_FOREST_DEPTH,
        minInstancesPerNode=params["min_samples_leaf"],
        featureSubsetStrategy=share if isinstance(share, str) else str(float(share)),
    )


def bootstrap_draws(tree: int, seed: int = MODEL_SEED) -> Column:
    """How often a row is drawn for a tree: Poisson with mean 1, from a hash of the row and the tree."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(tree), vector_to_array(VECTOR), F.col(LABEL)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    below, draws = 0.0, F.lit(0)
    for n in range(16):
        below += math.exp(-1) / math.factorial(n)
        draws = draws + (u >= F.lit(below)).cast("int")
    return draws


def subsample_forest(vectors: DataFrame, params: dict, parallelism: int = 8) -> list[Tree]:
    """Trees on bootstrap samples of their own, each balanced by the class sizes of its sample.

    Rows with the same features and label are drawn together.
    """
    numbers = list(range(params["n_estimators"]))
    sizes: dict[float, list[int]] = {}
    for start in range(0, len(numbers), 100):  # a hundred sums a job
        part = numbers[start : start + 100]
        for r in vectors.groupBy(LABEL).agg(*[F.sum(bootstrap_draws(t)).alias(f"n{t}") for t in part]).collect():
            sizes.setdefault(r[LABEL], []).extend(r[f"n{t}"] for t in part)

    def fit(tree: int) -> Tree:
        total = sum(n[tree] for n in sizes.values())
        weight = F.lit(0.0)
        for value, n in sizes.items():
            weight = F.when(F.col(LABEL) == value, F.lit(total / (2.0 * max(n[tree], 1)))).otherwise(weight)
        sample = vectors.withColumn("__n", bootstrap_draws(tree)).where("__n > 0").withColumn(WEIGHT, F.col("__n") * weight)
        one = random_forest({**params, "n_estimators": 1}, total).setBootstrap(False).setSeed(MODEL_SEED + tree)
        return forest_trees(one.fit(sample))[0]

    with ThreadPool(parallelism) as pool:
        return pool.map(fit, numbers)


def boosted_trees(params: dict, n_rows: int) -> HistogramBoosting:
    """Missing values go to the side of each split that suits them; no depth means no limit but that of the leaves."""
    return HistogramBoosting(
        params["max_iter"], params["max_depth"], params["learning_rate"], params["min_samples_leaf"],
        label=LABEL, weight=WEIGHT, vector=VECTOR,
    )


BUILDERS: dict[str, Callable[[dict, int], Estimator]] = {
    "lr": logistic_regression,
    "rf": random_forest,
    "gbm": boosted_trees,
}
SCALED_MODELS = {"lr"}
#: Models that see missing values as they are.
UNFILLED_MODELS = {"gbm"}


def select_names(wanted: str | Sequence[str], known: Sequence[str]) -> list[str]:
    """``"all"``, one name or several; an unknown name raises."""
    if wanted == "all":
        return list(known)
    names = [wanted] if isinstance(wanted, str) else list(wanted)
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown name {unknown}; valid: {list(known)}")
    return names


def grid_points(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def positive_probability(model: Model, df: DataFrame, name: str = "score") -> DataFrame:
    """Add the predicted probability of class 1."""
    scored = model.transform(df)
    return scored.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


@dataclass
class Roles:
    """One split's prepared rows by role; ``trainval`` is their stack."""

    train: DataFrame
    val: DataFrame
    trainval: DataFrame
    test: DataFrame

    @classmethod
    def of(cls, df: DataFrame, role: str = "split_role") -> Roles:
        in_role = lambda *names: df.where(F.col(role).isin(*names)).drop(role)
        return cls(in_role("train"), in_role("val"), in_role("train", "val"), in_role("test"))


@dataclass
class Fitted:
    name: str
    model: PipelineModel
    params: dict
    history: list[tuple[dict, float]] = field(default_factory=list)


def fit_prepared(name: str, vectors: DataFrame, params: dict) -> Model:
    """Fit one classifier on assembled vectors; the trees of a forest are pruned where ``ccp_alpha`` asks for it."""
    mode, alpha = params.get("class_weight"), params.get("ccp_alpha")
    if mode == "balanced_subsample":
        trees = subsample_forest(vectors, params)
        return forest_model([pruned(t, alpha) if alpha else t for t in trees])
    sizes = class_sizes(vectors)
    model = BUILDERS[name](params, sum(sizes.values())).fit(_weighted(vectors, mode, sizes))
    return forest_model([pruned(t, alpha) for t in forest_trees(model)]) if alpha else model


def as_trees(model: Model) -> TreeModel:
    """A fitted forest or boosted model by its node tables."""
    return model if isinstance(model, TreeModel) else forest_model(forest_trees(model))


def fit_one(name: str, train: DataFrame, features: Sequence[str], params: dict) -> PipelineModel:
    """Preparation and classifier fitted on the same rows."""
    with prepared_vectors(train, features, name in SCALED_MODELS, name not in UNFILLED_MODELS) as (prep, vectors):
        return PipelineModel([*prep.stages, fit_prepared(name, vectors, params)])


@contextmanager
def prepared_vectors(
    train: DataFrame, features: Sequence[str], scale: bool, fill: bool = True
) -> Iterator[tuple[PipelineModel, DataFrame]]:
    """The fitted preparation and the cached label and vector columns of its rows; not filled, NULL becomes NaN."""
    unfilled = [VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="keep")]
    prep = Pipeline(stages=imputing_stages(features, scale) if fill else unfilled).fit(train)
    vectors = prep.transform(train).select(LABEL, VECTOR).persist()
    try:
        yield prep, vectors
    finally:
        vectors.unpersist()


def average_precisions(models: Sequence[Model], df: DataFrame) -> list[float]:
    """Average precision of every model, all by the same jobs: one chained transform, then metrics by model."""
    out = df.select(LABEL, VECTOR)
    for i, model in enumerate(models):
        out = positive_probability(model, out, f"__p{i}")
    scores = F.array(*[F.struct(F.lit(i).alias("point"), F.col(f"__p{i}").alias("score")) for i in range(len(models))])
    found = ranking_metrics(out.select(LABEL, F.inline(scores)), LABEL, "score", ["point"])
    by_point = {r["point"]: r["average_precision"] for r in found.collect()}
    return [by_point.get(i, 0.0) for i in range(len(models))]


def tune(
    name: str, roles: Roles, features: Sequence[str], grid: dict[str, list] | None = None, parallelism: int = 1
) -> Fitted:
    """Try every grid point on train, rank by average precision on val, refit the best on both.

    No grid point changes the preparation, so the training rows are imputed and assembled once for
    the whole grid. Ties keep the first grid point. ``parallelism`` fits several points at once; the fitted ones are
    scored ``SCORED_TOGETHER`` at a time, by as many jobs as one would take.
    """
    points = grid_points(grid or GRIDS[name])
    with prepared_vectors(roles.train, features, name in SCALED_MODELS, name not in UNFILLED_MODELS) as (prep, vectors):
        val = prep.transform(roles.val).select(LABEL, VECTOR).persist()

        def fit(params: dict) -> Model:
            return fit_prepared(name, vectors, params)

        try:
            scores = []
            for start in range(0, len(points), SCORED_TOGETHER):
                part = points[start : start + SCORED_TOGETHER]
                if parallelism > 1:
                    with ThreadPool(parallelism) as pool:
                        fitted = pool.map(fit, part)
                else:
                    fitted = [fit(p) for p in part]
                scores += average_precisions(fitted, val)
        finally:
            val.unpersist()
    best = max(range(len(points)), key=lambda i: scores[i])
    model = fit_one(name, roles.trainval, features, points[best])
    return Fitted(name, model, points[best], list(zip(points, scores, strict=True)))


def soft_vote(models: dict[str, PipelineModel], df: DataFrame, name: str = "score") -> DataFrame:
    """Mean class-1 probability of several fitted models, in one chained transform."""
    out = df
    for key, model in models.items():
        out = positive_probability(model, out, f"__p_{key}")
    mean = sum((F.col(f"__p_{k}") for k in models), F.lit(0.0)) / F.lit(float(len(models)))
    return out.select(*df.columns, mean.alias(name))


def with_copies(df: DataFrame, key: Sequence[str], seed: int = MODEL_SEED) -> DataFrame:
    """How often each row counts so that both classes weigh the same, as ``COPIES``.

    The network has no instance weights. A row of the smaller class counts floor(ratio) times, plus
    once more where the hash of its key falls below the fractional part; no row is dropped.
    """
    sizes = class_sizes(df)
    if len(sizes) < 2:
        return df.withColumn(COPIES, F.lit(1))
    small = min(sizes, key=lambda k: sizes[k])
    ratio = max(sizes.values()) / sizes[small]
    draw = F.conv(F.substring(stable_hash(seed, *key), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    copies = F.lit(int(ratio)) + (draw < F.lit(ratio - int(ratio))).cast("int")
    return df.withColumn(COPIES, F.when(F.col(LABEL) == small, copies).otherwise(F.lit(1)))


def repeated(df: DataFrame) -> DataFrame:
    """Every row as often as it counts."""
    return df.withColumn(COPIES, F.explode(F.sequence(F.lit(1), F.col(COPIES)))).drop(COPIES)


def oversampled(df: DataFrame, key: Sequence[str], seed: int = MODEL_SEED) -> DataFrame:
    """Repeat rows of the smaller class so that both classes weigh the same."""
    return repeated(with_copies(df, key, seed))


def network_inputs(
    df: DataFrame, features: Sequence[str], nullable: Sequence[str], mask: bool
) -> tuple[DataFrame, list[str]]:
    """The masked variant zero-fills and appends indicators; the other one is imputed in the pipeline."""
    if not mask:
        return df, list(features)
    return with_missing_flags(df, nullable, features), [*features, *[f"{c}_missing" for c in nullable]]


def network(width: int, iterations: int) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        featuresCol=VECTOR, labelCol=LABEL, layers=[width, *HIDDEN_LAYERS, 2],
        maxIter=iterations, seed=MODEL_SEED,
    )


def log_loss(model: Model, df: DataFrame) -> float:
    """Class-weighted binary cross-entropy: positives weigh negatives / positives."""
    p = F.least(F.greatest(F.col("score"), F.lit(1e-12)), F.lit(1 - 1e-12))
    scored = positive_probability(model, df).select(LABEL, p.alias("p"))
    y = F.col(LABEL)
    row = scored.agg(
        F.sum(F.when(y == 1, -F.log("p"))).alias("pos"), F.count_if(y == 1).alias("np"),
        F.sum(F.when(y == 0, -F.log(F.lit(1.0) - F.col("p")))).alias("neg"), F.count_if(y == 0).alias("nn"),
    ).first()
    weight = row["nn"] / row["np"] if row["np"] else 1.0
    total = row["np"] + row["nn"]
    return ((row["pos"] or 0.0) * weight + (row["neg"] or 0.0)) / total if total else float("inf")


@contextmanager
def network_blocks(train: DataFrame, columns: Sequence[str]) -> Iterator[tuple[PipelineModel, DataFrame]]:
    """The preparation fitted on all copies, and the cached blocks of its rows, each row once."""
    prep = Pipeline(stages=imputing_stages(columns, scale=True)).fit(repeated(train))
    vectors = prep.transform(train).select(LABEL, COPIES, VECTOR)
    held = train.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.count("*")).first()
    blocks = blocks_of(vectors, LABEL, VECTOR, COPIES).coalesce(even_tasks(held[0] or 0, held[1])).persist()
    try:
        yield prep, blocks
    finally:
        blocks.unpersist()


def even_tasks(rows: int, partitions: int) -> int:
    """Tasks with equally many partitions each (but the last), of ``TASK_ROWS`` rows or less if there are enough partitions."""
    wanted = max(1, min(MAX_TASKS, -(-rows // TASK_ROWS)))
    each = max(1, partitions // wanted, -(-partitions // MAX_TASKS))
    return max(1, -(-partitions // each))


def network_of(spark: SparkSession, width: int, weights: np.ndarray | None = None) -> Model:
    """The network of these weights, or of its seeded ones, before any iteration."""
    rows = [(float(i), DenseVector([0.0] * width)) for i in (0, 1)]
    step = network(width, 0)
    step = step if weights is None else step.setInitialWeights(DenseVector(weights))
    return step.fit(spark.createDataFrame(rows, [LABEL, VECTOR]))


def network_objective(blocks: DataFrame, width: int) -> Evaluate:
    return objective(blocks, [width, *HIDDEN_LAYERS, 2])


def resumed(blocks: DataFrame, width: int, iterations: int, model: Model | None, evaluate: Evaluate | None = None) -> Model:
    """The network after further iterations from this one, or from its seeded weights.

    With the ``evaluate`` of the fit so far, the point where that fit ended is not worked out again.
    """
    model = model or network_of(blocks.sparkSession, width)
    evaluate = evaluate or network_objective(blocks, width)
    return network_of(blocks.sparkSession, width, minimised(evaluate, model.weights.toArray(), iterations))


def fit_network(blocks: DataFrame, width: int, iterations: int, every: int) -> Model:
    """A network of this many iterations, resumed as often as in the search for their number."""
    model, evaluate = None, network_objective(blocks, width)
    for done in range(0, iterations, every):
        model = resumed(blocks, width, min(every, iterations - done), model, evaluate)
    return model


def train_network(
    name: str,
    roles: Roles,
    features: Sequence[str],
    nullable: Sequence[str],
    key: Sequence[str],
    max_iterations: int = MAX_ITERATIONS,
    every: int = CHECK_EVERY,
    patience: int = PATIENCE,
) -> Fitted:
    """Pick the iteration count with the lowest validation loss, then refit on train and val for as many.

    One fit goes on from look to look, ``every`` iterations apart, and stops after ``patience`` looks in a row
    without a lower loss, or at ``max_iterations``. The history has every look.
    """
    mask = NETWORKS[name]
    view = lambda df: network_inputs(df, features, nullable, mask)
    train, columns = view(with_copies(roles.train, key))
    history: list[tuple[dict, float]] = []
    with network_blocks(train, columns) as (prep, blocks):
        val = prep.transform(view(roles.val)[0]).select(LABEL, VECTOR).persist()
        model, best, evaluate = None, 0, network_objective(blocks, len(columns))
        try:
            while len(history) * every < max_iterations and len(history) - best <= patience:
                done = len(history) * every
                model = resumed(blocks, len(columns), min(every, max_iterations - done), model, evaluate)
                history.append(({"iterations": min(done + every, max_iterations)}, log_loss(model, val)))
                if history[-1][1] < history[best][1]:
                    best = len(history) - 1
        finally:
            val.unpersist()
    chosen = history[best][0]
    with network_blocks(view(with_copies(roles.trainval, key))[0], columns) as (prep, blocks):
        model = PipelineModel([*prep.stages, fit_network(blocks, len(columns), chosen["iterations"], every)])
    return Fitted(name, model, {**chosen, "use_mask": mask, "input_dim": len(columns)}, history)


def test_metrics(scored: DataFrame) -> dict[str, float]:
    kept = scored.select(LABEL, "score").persist()
    try:
        row = compute_metrics(kept, LABEL, "score").first()
        return {m: row[m] for m in METRIC_NAMES}
    finally:
        kept.unpersist()


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A saved model; a path without one raises FileNotFoundError, any other failure is raised as it is."""
    spark = SparkSession.active()
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(f"no saved model at {path}")
    return PipelineModel.load(path)
