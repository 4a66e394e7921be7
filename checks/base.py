"""Registry and shared inputs of the checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.clean import coverage_join, pair_bridge
from starloom.operators.labels import (
    absence_label,
    agreement,
    best_match,
    join_through_bridge,
    relation_label,
)
from starloom.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/checks-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The frame as a written table, as between the layers of the pipeline."""
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)


def q(expression: str, digits: int = 4) -> str:
    """SQL twin of ``quantise``."""
    return f"floor(({expression}) * 1e{digits} + 0.5) / 1e{digits}"


def bin_sql(v: str, lo: str, hi: str, bins: int) -> str:
    """SQL twin of ``bin_index`` for values below ``hi``, with ``hi`` itself in the last bin."""
    step = f"(({hi} - {lo}) / {bins}.0::DOUBLE)"
    guess = f"floor(({v} - {lo}) * {bins}.0::DOUBLE / ({hi} - {lo}))"
    return (
        f"least({guess} - ({v} < {lo} + {guess} * {step})::INTEGER"
        f" + ({v} >= {lo} + ({guess} + 1.0::DOUBLE) * {step})::INTEGER, {bins - 1})::INTEGER"
    )


def q_pct(part: str, whole: str, digits: int = 1) -> str:
    return q(f"100.0::DOUBLE * ({part}) / ({whole})", digits)


# A labelled population derived from orders and lineitem: an order is an object, its status the kind,
# status and priority together its population, its returned lines the shape record, and its suppliers
# the match candidates with a score from the quantity.
SHAPE_SLOPE, SHAPE_INTERCEPT, RECORD_LIMIT, MATCH_LIMIT = 0.1, 0.05, 100_000.0, 0.6


def orders_as_objects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("object_id"),
        F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("population"),
        F.col("o_orderstatus").alias("kind"),
        F.col("o_totalprice").alias("mass"),
    )


def shape_source(spark: SparkSession, sf: str) -> DataFrame:
    returned = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    return returned.groupBy(F.col("l_orderkey").alias("object_id")).agg(
        (F.avg("l_discount") * 10.0).alias("shape"), F.sum("l_extendedprice").alias("rec_mass")
    )


def match_source(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("object_id"),
        F.col("l_suppkey").alias("candidate"),
        (F.col("l_quantity") * F.col("l_quantity") / 2500.0).alias("score"),
    )
    pairs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("object_id"), F.col("o_orderpriority").alias("pair")
    )
    return lines.join(pairs, "object_id")


def populations(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .select(
            F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("population"),
            F.col("o_orderstatus").alias("kind"),
            F.col("o_orderpriority").alias("priority"),
        )
        .distinct()
    )


def bridge(spark: SparkSession, sf: str) -> DataFrame:
    dims = populations(spark, sf)
    pairs = dims.select(F.col("priority").alias("pair"), "priority").distinct()
    return pair_bridge(
        dims, pairs, "pair", ["priority"], "population", "kind", "F", "O", "f_population", "o_population"
    )


def covered_objects(spark: SparkSession, sf: str) -> DataFrame:
    return coverage_join(
        orders_as_objects(spark, sf), shape_source(spark, sf), ["object_id"], ["shape", "rec_mass"], "shape", "has_record"
    )


def labelled_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of kind F with both labels and their agreement."""
    matches = best_match(match_source(spark, sf), ["pair", "object_id"], "candidate", "score", MATCH_LIMIT, found="found")
    joined = join_through_bridge(
        covered_objects(spark, sf).where(F.col("kind") == "F"),
        bridge(spark, sf), matches, "population", "f_population", "pair", "object_id", "object_id", "found",
    )
    return joined.select(
        "object_id", "population", "kind", "mass", "shape", "rec_mass", "has_record",
        relation_label(
            F.col("has_record"), F.col("shape"), F.col("rec_mass"), SHAPE_SLOPE, SHAPE_INTERCEPT, RECORD_LIMIT
        ).alias("by_relation"),
        absence_label(F.col("found")).alias("by_match"),
    ).withColumn("agree", agreement(F.col("by_relation"), F.col("by_match")))


OBJECTS_SQL = f"""
obj AS (SELECT o_orderkey AS object_id, o_orderstatus || ':' || o_orderpriority AS population,
               o_orderstatus AS kind, o_totalprice AS mass FROM orders),
rec AS (SELECT l_orderkey AS object_id, avg(l_discount) * 10.0::DOUBLE AS shape, sum(l_extendedprice) AS rec_mass
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey),
hit AS (SELECT l_orderkey AS object_id, max(l_quantity * l_quantity / 2500.0::DOUBLE) >= {MATCH_LIMIT}::DOUBLE AS found
        FROM lineitem GROUP BY l_orderkey),
cov AS (SELECT obj.*, rec.shape, rec.rec_mass, rec.shape IS NOT NULL AS has_record
        FROM obj LEFT JOIN rec USING (object_id)),
lab0 AS (SELECT cov.*,
           CASE WHEN NOT has_record THEN NULL WHEN rec_mass >= {RECORD_LIMIT}::DOUBLE THEN FALSE
                WHEN shape < {SHAPE_SLOPE}::DOUBLE * log10(rec_mass) + {SHAPE_INTERCEPT}::DOUBLE THEN TRUE
                ELSE FALSE END AS by_relation,
           NOT coalesce(hit.found, FALSE) AS by_match
         FROM cov LEFT JOIN hit USING (object_id) WHERE kind = 'F'),
lab AS (SELECT *, by_relation = by_match AS agree FROM lab0)
"""
