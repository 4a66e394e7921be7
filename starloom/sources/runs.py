"""The run log: one row per trained model with its parameters and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_SCHEMA = T.StructType([
    T.StructField("run_name", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("split_name", T.StringType(), False),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
])


def run_row(spark: SparkSession, model: str, split: str, params: dict, metrics: dict[str, float]) -> DataFrame:
    """One finished run as a row of the log."""
    text = {k: str(v) for k, v in params.items()} | {"model": model, "split_name": split}
    numbers = {k: None if v is None else float(v) for k, v in metrics.items()}
    return spark.createDataFrame([(f"{model}_{split}", model, split, text, numbers)], RUN_SCHEMA)


def append_run(df: DataFrame, table: str) -> None:
    df.write.format("parquet").mode("append").saveAsTable(table)


def runs_from_metrics(df: DataFrame, model: str, split: str, metrics: Sequence[str]) -> DataFrame:
    """Metric rows per (model, split) in the shape of the run log."""
    pairs = [x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]
    return df.select(
        F.concat_ws("_", model, split).alias("run_name"),
        F.col(model).alias("model"),
        F.col(split).alias("split_name"),
        F.create_map(F.lit("model"), F.col(model), F.lit("split_name"), F.col(split)).alias("params"),
        F.create_map(*pairs).alias("metrics"),
    )


def metric(name: str, *older_names: str) -> Column:
    """A metric by name, falling back to older names of it."""
    return F.coalesce(*[F.try_element_at("metrics", F.lit(n)) for n in (name, *older_names)])


def split_metrics(runs: DataFrame, split: str, names: Sequence[str], prefix: str = "") -> DataFrame:
    """Metrics of one split as columns, best average precision first.

    Names no run of the split has are left out, as are columns that are empty throughout.
    """
    chosen = runs.where(F.col("split_name") == split)
    known = {r["k"] for r in chosen.select(F.explode(F.map_keys("metrics")).alias("k")).distinct().collect()}
    kept = [n for n in names if prefix + n in known]
    table = chosen.select("model", *[F.col("metrics")[prefix + n].alias(n) for n in kept])
    order = [F.desc("test_average_precision")] if "test_average_precision" in kept else []
    return table.orderBy(*order, "model")


def generalisation_table(runs: DataFrame) -> DataFrame:
    """All complete runs by split, best average precision first."""
    return (
        runs.select(
            "model",
            F.col("split_name").alias("split"),
            metric("test_average_precision", "average_precision").alias("avg_precision"),
            metric("test_roc_auc", "roc_auc").alias("roc_auc"),
            metric("test_f1", "f1").alias("f1"),
            metric("test_f1_genuine", "f1_genuine").alias("f1_genuine"),
        )
        .where(F.col("avg_precision").isNotNull() & F.col("roc_auc").isNotNull() & F.col("f1").isNotNull())
        .orderBy("split", F.desc("avg_precision"), "model")
    )
