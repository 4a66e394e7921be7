"""Feature contributions and the importance tables built from them."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linear_contributions(
    df: DataFrame, keys: Sequence[str], coefficients: dict[str, float], means: DataFrame
) -> DataFrame:
    """Exact contributions coef * (x - mean) of a linear model, one row per (row, feature)."""
    features = list(coefficients)
    parts = df.select(
        *keys,
        *[F.col(c).cast("double").alias(c) for c in features],
        *[means.select(c).scalar().alias(f"__m_{c}") for c in features],
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).alias("value"),
            (F.lit(float(coefficients[c])) * (F.col(c) - F.col(f"__m_{c}"))).alias("contribution"),
        )
        for c in features
    ])
    return parts.select(*keys, F.inline(rows))


def feature_orders(n_features: int, n_orders: int, seed: int) -> list[list[int]]:
    """Seeded random orders in antithetic pairs: each order is followed by its reverse."""
    rng = random.Random(seed)
    orders: list[list[int]] = []
    while len(orders) < n_orders:
        order = list(range(n_features))
        rng.shuffle(order)
        orders += [order, order[::-1]]
    return orders[:n_orders]


def sampled_contributions(
    df: DataFrame,
    background: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    n_orders: int = 8,
    seed: int = 42,
    max_background: int = 1000,
    vector: str = "features",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Sampled Shapley values of any model: one row per (row, feature).

    For every feature order the row is walked from a background row to itself, one feature at a
    time; a feature's contribution is the score change at its step, averaged over the orders. Each
    row uses the background rows in turn, chosen by the hash of its key. All mixtures are scored in
    one ``transform``; a mixture adds its score to the feature just switched on and takes it off the
    feature switched on next, so the result needs a single map-side combined aggregate and no
    comparison of neighbouring rows. Work is linear in the rows: orders * (features + 1) mixtures each.

    ``score`` takes a frame with the vector column and adds a double column ``score``. ``background``
    must be a sample of at most ``max_background`` rows; it travels as a literal array.
    """
    features, keys, carry = list(features), list(keys), list(carry)
    d = len(features)
    sample = background.select(
        F.array(*[F.col(c).cast("double") for c in features]).alias("b")
    ).limit(max_background + 1).collect()
    if not 0 < len(sample) <= max_background:
        raise ValueError(f"background must have 1 to {max_background} rows")
    orders = feature_orders(d, n_orders, seed)
    position = [[order.index(j) for j in range(d)] for order in orders]
    spark = df.sparkSession
    pool = spark.createDataFrame(
        [(i, list(r["b"])) for i, r in enumerate(sample)], "__bg int, __b array<double>"
    )
    walks = F.array(*[
        F.struct(
            F.lit(i).alias("order_id"),
            F.array(*[F.lit(j) for j in order]).alias("order"),
            F.array(*[F.lit(p) for p in position[i]]).alias("position"),
        )
        for i, order in enumerate(orders)
    ])
    own = F.array(*[F.col(c).cast("double") for c in features])
    walked = (
        df.select(*keys, *carry, own.alias("__x"))
        .select(*keys, *carry, "__x", F.explode(walks).alias("__walk"))
        .withColumn(
            "__bg",
            F.pmod(F.xxhash64(F.lit(seed), F.col("__walk.order_id"), *keys), F.lit(len(sample))).cast("int"),
        )
        .join(F.broadcast(pool), "__bg")
        .withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    )
    mixture = F.transform(
        F.arrays_zip(F.col("__x").alias("x"), F.col("__b").alias("b"), F.col("__walk.position").alias("p")),
        lambda e: F.when(e["p"] < F.col("__step"), e["x"]).otherwise(e["b"]),
    )
    scored = score(walked.withColumn(vector, array_to_vector(mixture)))
    names = F.array(*[F.lit(c) for c in features])
    order = F.col("__walk.order")
    share = F.col("score") / F.lit(float(n_orders))

    def entry(at: Column, sign: float) -> Column:
        return F.struct(at.alias("__j"), (F.lit(sign) * share).alias("__c"))

    gained = F.when(F.col("__step") > 0, entry(F.get(order, F.col("__step") - 1), 1.0))
    lost = F.when(F.col("__step") < d, entry(F.get(order, F.col("__step")), -1.0))
    return (
        scored.select(*keys, *carry, "__x", F.inline(F.array_compact(F.array(gained, lost))))
        .groupBy(*keys, *carry, "__j")
        .agg(F.first(F.get(F.col("__x"), F.col("__j"))).alias("value"), F.sum("__c").alias("contribution"))
        .select(*keys, *carry, F.get(names, F.col("__j")).alias("feature"), "value", "contribution")
    )


def importance(contributions: DataFrame, group: Sequence[str] = (), normalise: bool = True) -> DataFrame:
    """Mean absolute contribution per group and feature; normalised it sums to 1 per group."""
    means = contributions.groupBy(*group, "feature").agg(F.avg(F.abs("contribution")).alias("importance"))
    if not normalise:
        return means
    # One row per (group, feature) reaches this window.
    total = F.sum("importance").over(Window.partitionBy(*(list(group) or [F.lit(1)])))
    return means.withColumn("importance", F.try_divide(F.col("importance"), total))


def ranked(scores: DataFrame, group: Sequence[str] = (), value: str = "importance", rank: str = "rank") -> DataFrame:
    """Rank of every feature, highest first, ties by name."""
    order = Window.partitionBy(*(list(group) or [F.lit(1)])).orderBy(F.desc(value), "feature")
    return scores.withColumn(rank, F.row_number().over(order))


def top_features(scores: DataFrame, k: int = 4, value: str = "importance") -> DataFrame:
    return scores.orderBy(F.desc(value), "feature").limit(k)


def importance_matrix(contributions: DataFrame, split: str, splits: Sequence[str], reference: str) -> DataFrame:
    """Feature by split importance, with the rank in the reference split."""
    wide = (
        importance(contributions, [split])
        .groupBy("feature")
        .pivot(split, list(splits))
        .agg(F.first("importance"))
    )
    return ranked(wide, value=reference)


def contribution_points(contributions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per row and feature the value and its contribution."""
    return contributions.select(*keys, "feature", "value", "contribution")


def dependence_points(contributions: DataFrame, keys: Sequence[str], k: int = 4) -> DataFrame:
    """For the k most important features: value, contribution, and the row's value of the most
    important other feature."""
    keys = list(keys)
    best = ranked(importance(contributions)).where(F.col("rank") <= k + 1)
    ranks = {r["rank"]: r["feature"] for r in best.select("rank", "feature").collect()}
    shown = [ranks[r] for r in sorted(ranks) if r <= k]
    first, second = ranks[1], ranks.get(2, ranks[1])
    colours = contributions.where(F.col("feature").isin(first, second)).groupBy(*keys).agg(
        F.max(F.when(F.col("feature") == first, F.col("value"))).alias("__first"),
        F.max(F.when(F.col("feature") == second, F.col("value"))).alias("__second"),
    )
    points = contributions.where(F.col("feature").isin(shown)).join(colours, keys)
    is_first = F.col("feature") == first
    return points.select(
        *keys,
        "feature",
        "value",
        "contribution",
        F.when(is_first, F.lit(second)).otherwise(F.lit(first)).alias("colour_feature"),
        F.when(is_first, F.col("__second")).otherwise(F.col("__first")).alias("colour_value"),
    )


def flag_importance(contributions: DataFrame, flag: str, on: str = "host", off: str = "sub") -> DataFrame:
    """Normalised importance for flagged and unflagged rows side by side, with the difference."""
    named = contributions.withColumn("__side", F.when(F.col(flag), on).otherwise(off))
    wide = importance(named, ["__side"]).groupBy("feature").pivot("__side", [on, off]).agg(F.first("importance"))
    return wide.withColumn("difference", F.col(on) - F.col(off))


def indicator_importance(
    contributions: DataFrame, features: Sequence[str], suffix: str = "_missing"
) -> DataFrame:
    """Raw importance of nullable features next to that of their missing indicators."""
    base = F.regexp_replace("feature", f"{suffix}$", "")
    kept = contributions.where(base.isin(list(features)))
    is_flag = F.col("feature").endswith(suffix)
    size = F.abs("contribution")
    return kept.groupBy(base.alias("feature")).agg(
        F.avg(F.when(~is_flag, size)).alias("feature_importance"),
        F.avg(F.when(is_flag, size)).alias("indicator_importance"),
    )
