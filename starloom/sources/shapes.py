"""Shape records from columnar files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import scale_factor, snapshot_number

# Required input columns.
SHAPE_COLUMNS = ("sphericity_halfmaxmass", "halfmaxmass", "mhalo_halfmaxmass")


def shape_records(raw: DataFrame, population: str, key: str = "halo_id", id_column: str = "simulation_id") -> DataFrame:
    """Typed records of one population; wide columns that are not named here are never read."""
    missing = ({key} | set(SHAPE_COLUMNS)) - set(raw.columns)
    if missing:
        raise ValueError(f"shape records of {population} lack {sorted(missing)}")
    return raw.select(
        F.lit(population).alias(id_column),
        F.col(key).cast("bigint").alias(key),
        F.col("sphericity_halfmaxmass").cast("double").alias("sphericity_s"),
        snapshot_number("halfmaxmass").alias("snap_hmm"),
        scale_factor("halfmaxmass").alias("a_hmm"),
        F.col("mhalo_halfmaxmass").cast("double").alias("m_hmm"),
    )


def read_shapes(spark: SparkSession, paths: dict[str, str], key: str = "halo_id") -> DataFrame:
    """Shape records of all populations, one file or directory each, read in one job."""
    parts = [shape_records(spark.read.parquet(p), k, key) for k, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)
