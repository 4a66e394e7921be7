"""Match reduction and the two independent labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions import linear_relation


def best_match(
    candidates: DataFrame,
    parent: Sequence[str],
    candidate: str,
    score: str,
    threshold: float,
    found: str = "has_counterpart",
    best_candidate: str = "best_candidate",
    best_score: str = "best_score",
) -> DataFrame:
    """One row per parent: its best candidate at or above the threshold, or a typed NULL.

    A single ranking answers both questions. Passing candidates sort first, so the first row of a
    parent is its best match if there is one and otherwise only proves that the parent was seen.
    Ties go to the lower candidate id. The rank filter is applied before the shuffle as well, so a
    parent with very many candidates sends one row per input partition.
    """
    parent = list(parent)
    passes = F.coalesce(F.col(score) >= F.lit(threshold), F.lit(False))
    order = Window.partitionBy(*parent).orderBy(
        F.col("__pass").desc(), F.col(score).desc_nulls_last(), F.col(candidate).asc_nulls_last()
    )
    first = (
        candidates.select(*parent, candidate, score)
        .withColumn("__pass", passes)
        .withColumn("__rank", F.row_number().over(order))
        .where(F.col("__rank") == 1)
    )
    return first.select(
        *parent,
        F.when(F.col("__pass"), F.col(candidate)).alias(best_candidate),
        F.when(F.col("__pass"), F.col(score)).alias(best_score),
        F.col("__pass").alias(found),
    )


def top_candidates(
    candidates: DataFrame, parent: Sequence[str], candidate: str, score: str, threshold: float
) -> DataFrame:
    """Only the parents with a candidate at or above the threshold, one best row each."""
    order = Window.partitionBy(*parent).orderBy(F.col(score).desc(), F.col(candidate).asc())
    return (
        candidates.where(F.col(score) >= threshold)
        .select(*parent, candidate, score)
        .withColumn("__rank", F.row_number().over(order))
        .where(F.col("__rank") == 1)
        .drop("__rank")
    )


def unmatched_parents(candidates: DataFrame, matched: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Distinct parents that occur among the candidates but not among the matched rows."""
    return candidates.select(*parent).distinct().join(matched.select(*parent), list(parent), "left_anti")


def relation_label(
    has_record: Column, shape: Column, mass: Column, alpha: float, beta: float, mass_threshold: float
) -> Column:
    """Three-valued label: NULL without a record, False at or above the mass threshold, otherwise
    True where the shape lies below alpha * log10(mass) + beta."""
    return (
        F.when(~has_record, F.lit(None).cast("boolean"))
        .when(mass >= F.lit(float(mass_threshold)), F.lit(False))
        .when(shape < linear_relation(mass, alpha, beta), F.lit(True))
        .otherwise(F.lit(False))
    )


def absence_label(found: Column) -> Column:
    """True where no counterpart was found; an absent match row counts as not found."""
    return ~F.coalesce(found, F.lit(False))


def agreement(a: Column, b: Column) -> Column:
    """Equality that is NULL if either side is NULL."""
    return a == b


def join_through_bridge(
    objects: DataFrame,
    bridge: DataFrame,
    matches: DataFrame,
    population: str,
    bridge_population: str,
    pair: str,
    object_id: str,
    match_object_id: str,
    found: str,
) -> DataFrame:
    """Objects with the match flag of their pair; objects without pair or match keep NULL."""
    lookup = bridge.select(F.col(bridge_population).alias(population), pair)
    flags = matches.select(pair, F.col(match_object_id).alias(object_id), found)
    return objects.join(lookup, population, "left").join(flags, [pair, object_id], "left")
