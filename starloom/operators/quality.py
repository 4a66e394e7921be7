"""Row counts, rates of written tables, and table rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per named table with its row count."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def _rates(df: DataFrame, total: Column, hit: Column) -> DataFrame:
    # files without a row group give a NULL count, which the planner does not expect: coalesce would be dropped
    counted = df.agg(total.alias("n_total"), hit.alias("n_hit")).select(
        *[F.greatest(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("n_total", "n_hit")]
    )
    return counted.select(
        "n_total",
        "n_hit",
        (F.col("n_total") - F.col("n_hit")).alias("n_miss"),
        F.coalesce(F.try_divide(F.lit(100.0) * F.col("n_hit"), F.col("n_total")), F.lit(0.0)).alias("pct_hit"),
    )


def hit_rate(df: DataFrame, condition: Column) -> DataFrame:
    """One row: rows, rows that meet a condition, rows that do not, and the percentage."""
    return _rates(df, F.count(F.lit(1)), F.count_if(condition))


def written_rate(spark: SparkSession, folder: str, column: str, filled: bool = True) -> DataFrame:
    """``hit_rate`` of "the column is filled" (or "is NULL") for a written Parquet table, without a scan.

    The writer has counted rows and NULLs of every column while it wrote, in the footers of the files; the
    aggregate is answered from these counts. The settings for that live in a session of their own. Unlike an
    observation attached to the write this leaves no state in the caller's session (a session that has
    observed once can no longer ship fitted models that hold a training summary).
    """
    reader = spark.newSession()
    reader.conf.set("spark.sql.sources.useV1SourceList", "")
    reader.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    total, known = F.count(F.lit(1)), F.count(F.col(column))
    return _rates(reader.read.parquet(folder), total, known if filled else total - known)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def _violations(df: DataFrame, rule: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(rule).alias("rule"), "n_violations")


def rule_unique(df: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    return _violations(duplicate_keys(df, key), rule)


def rule_holds(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each row-level rule; a NULL result counts as broken. One scan for all."""
    names = {r: f"__rule{i}" for i, r in enumerate(rules)}
    broken = [F.count_if(~F.coalesce(c, F.lit(False))).alias(names[r]) for r, c in rules.items()]
    rows = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(n).alias("n_violations")) for r, n in names.items()
    ])
    return df.agg(*broken).select(F.inline(rows))


def rule_references(df: DataFrame, column: str, target: DataFrame, target_column: str, rule: str) -> DataFrame:
    """Rows whose value is unknown in the referenced table."""
    known = target.select(F.col(target_column).alias(column)).distinct()
    return _violations(df.join(known, column, "left_anti"), rule)


def violations(*checks: DataFrame) -> DataFrame:
    """One row per violated rule with its count."""
    return reduce(DataFrame.unionByName, checks).where(F.col("n_violations") > 0)


def assert_no_violations(*checks: DataFrame) -> None:
    broken = violations(*checks).limit(100).collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['n_violations']}" for r in broken))


def population_rules(populations: DataFrame) -> list[DataFrame]:
    """Rules of the population dimension table."""
    return [
        rule_unique(populations, ["simulation_id"], "duplicate simulation_id"),
        rule_holds(
            populations,
            {
                "cosmology is CDM or WDM": F.col("cosmology").isin("CDM", "WDM"),
                "softening is fixed or adaptive": F.col("softening").isin("fixed", "adaptive"),
            },
        ),
    ]


def parameter_rules(spark: SparkSession, parameters: dict[str, float]) -> DataFrame:
    """Rules of the scalar settings: shares and threshold in (0, 1), train + val below 1."""
    table = spark.createDataFrame([tuple(float(v) for v in parameters.values())], list(parameters))
    open_unit = {
        f"{p} in (0, 1)": (F.col(p) > 0) & (F.col(p) < 1)
        for p in ("merit_threshold", "train_fraction", "val_fraction")
    }
    return rule_holds(
        table,
        open_unit | {"train_fraction + val_fraction < 1": F.col("train_fraction") + F.col("val_fraction") < 1},
    )
