"""Column clean-up, flags, enrichment and coverage joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the columns that exist; absent names are ignored."""
    return df.drop(*columns)


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that exist; absent names are ignored."""
    return df.withColumnsRenamed(names)


def host_flags(df: DataFrame, host: str, is_host: str = "is_host", is_sub: str = "is_subhalo") -> DataFrame:
    """Host id 0 marks an object without a host."""
    return df.withColumns({is_host: F.col(host) == 0, is_sub: F.col(host) != 0})


def below_limit(value: Column, limit: float) -> Column:
    return value < F.lit(limit)


def enrich(df: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join of dimension attributes. The dimension is broadcast by size, not by hint."""
    return df.join(dimension.select(key, *columns), key, "left")


def coverage_join(
    df: DataFrame,
    records: DataFrame,
    key: Sequence[str],
    columns: Sequence[str],
    indicator: str,
    flag: str,
) -> DataFrame:
    """Keep every row, attach the record columns, and flag whether a record exists."""
    return df.join(records.select(*key, *columns), list(key), "left").withColumn(
        flag, F.col(indicator).isNotNull()
    )


def pair_bridge(
    populations: DataFrame,
    pairs: DataFrame,
    pair: str,
    on: Sequence[str],
    population: str,
    side: str,
    left_value: str,
    right_value: str,
    left_name: str,
    right_name: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """For each pair the one left and the one right population with the same attributes.

    A pair that does not find exactly one population on each side raises when the result is read.
    """
    grouped = populations.groupBy(*on).agg(
        F.count_if(F.col(side) == left_value).alias("__nl"),
        F.count_if(F.col(side) == right_value).alias("__nr"),
        F.max(F.when(F.col(side) == left_value, F.col(population))).alias(left_name),
        F.max(F.when(F.col(side) == right_value, F.col(population))).alias(right_name),
        *[F.max(F.when(F.col(side) == left_value, F.col(c))).alias(c) for c in carry],
    )
    joined = pairs.select(pair, *on).join(grouped, list(on), "left")
    n_left, n_right = F.coalesce("__nl", F.lit(0)), F.coalesce("__nr", F.lit(0))
    problem = F.concat(
        F.lit("pair "), F.col(pair).cast("string"), F.lit(": found "),
        n_left.cast("string"), F.lit(f" {left_value} and "), n_right.cast("string"),
        F.lit(f" {right_value} populations, expected one of each"),
    )
    checked = F.when((n_left == 1) & (n_right == 1), F.col(pair)).otherwise(
        F.raise_error(problem).cast(pairs.schema[pair].dataType)
    )
    return joined.select(checked.alias(pair), left_name, right_name, *on, *carry)
