"""Layer namespaces and idempotent table writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Layer names and the typed population dimension.
LAYERS = ("bronze", "silver", "gold")
POPULATION_SCHEMA = T.StructType([
    T.StructField("simulation_id", T.StringType(), False),
    T.StructField("cosmology", T.StringType(), False),
    T.StructField("softening", T.StringType(), False),
    T.StructField("n_part_per_side", T.IntegerType(), False),
    T.StructField("z_ini", T.FloatType(), False),
    T.StructField("box_size_mpc_h", T.FloatType(), False),
    T.StructField("particle_mass_msun_h", T.FloatType(), False),
    T.StructField("raw_file_path", T.StringType(), True),
])


def dimension_table(spark: SparkSession, records: Sequence[dict], schema: T.StructType) -> DataFrame:
    """Configured records as a typed table."""
    rows = []
    for r in records:
        rows.append(tuple(
            float(r[f.name]) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and r[f.name] is not None
            else r[f.name]
            for f in schema.fields
        ))
    return spark.createDataFrame(rows, schema)


def create_layers(
    spark: SparkSession, layers: Sequence[str] = LAYERS, folder: str | None = None
) -> None:
    """Create the layers that are not there yet, below a folder or in the session's warehouse."""
    for layer in layers:
        place = f" LOCATION '{folder}/{layer}'" if folder else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{layer}`{place}")


def reset_layers(
    spark: SparkSession, layers: Sequence[str] = LAYERS, folder: str | None = None
) -> None:
    """Drop the layers with all their tables and create them empty."""
    for layer in layers:
        spark.sql(f"DROP DATABASE IF EXISTS `{layer}` CASCADE")
    create_layers(spark, layers, folder)


def replace_table(
    df: DataFrame, name: str, bucket_by: Sequence[str] = (), buckets: int = 0
) -> DataFrame:
    """Write a table as a whole and return it; running twice gives the same table.

    The new content is complete before the old table steps aside, so a plan that reads the table it
    replaces works and a failed write leaves the old content. The old table is dropped only when the new one
    has its name; a switch that broke off in between is finished by ``recover_table``, which runs here first
    and which readers may call. With ``buckets`` the rows are stored
    hashed and sorted by ``bucket_by``, so that later joins of such tables on these columns need no
    shuffle; the rows are moved once here, one file per bucket.
    """
    spark = df.sparkSession
    staging, former = f"{name}__staging", f"{name}__former"
    recover_table(spark, name)
    for leftover in (staging, former):
        spark.sql(f"DROP TABLE IF EXISTS {leftover}")
    if buckets:
        keys = list(bucket_by)
        writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    else:
        writer = df.write
    writer.format("parquet").mode("overwrite").saveAsTable(staging)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {former}")
    spark.sql(f"ALTER TABLE {staging} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {former}")
    return spark.table(name)


def table_folder(spark: SparkSession, name: str) -> str:
    """Where the files of a table are."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").select("data_type")
    return rows.first()[0]


def recover_table(spark: SparkSession, name: str) -> bool:
    """Finish a replacement that broke off between its two renames; whether there was one.

    The old table steps aside only once the new content is complete, so the new one takes the name.
    """
    staging, former = f"{name}__staging", f"{name}__former"
    if spark.catalog.tableExists(name) or not spark.catalog.tableExists(former):
        return False
    complete = staging if spark.catalog.tableExists(staging) else former
    spark.sql(f"ALTER TABLE {complete} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {former}")
    return True
