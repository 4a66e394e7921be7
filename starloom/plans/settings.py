"""Driver-side settings of the catalogue pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions import setup_redshift, setup_softening
from starloom.operators.quality import (
    assert_no_violations,
    parameter_rules,
    population_rules,
    rule_references,
    rule_unique,
)
from starloom.sources.tables import POPULATION_SCHEMA, dimension_table


@dataclass(frozen=True)
class Population:
    """One simulated population and where its files are."""

    simulation_id: str
    cosmology: str
    softening: str
    n_part_per_side: int
    z_ini: int
    box_size_mpc_h: float
    particle_mass_msun_h: float
    catalogue_dir: str
    shapes_path: str


@dataclass(frozen=True)
class SplitSpec:
    train: tuple[str, ...]
    test: tuple[str, ...]


@dataclass(frozen=True)
class Settings:
    """Parameters; the defaults are the published values."""

    populations: tuple[Population, ...]
    matches: dict[str, str]
    splits: dict[str, SplitSpec]
    merit_threshold: float = 0.1
    alpha: float = 0.0624
    beta: float = -0.0988
    mass_threshold_log10: float = 10.0
    neighbour_radius_mpc_h: float = 1.0
    random_seed: int = 1122334455
    train_fraction: float = 0.6
    val_fraction: float = 0.2
    layers: tuple[str, str, str] = field(default=("bronze", "silver", "gold"))
    # Buckets of the tables keyed by object; 0 leaves them unbucketed. At scale: total size / 128 MB.
    buckets: int = 0


WITHIN = "within_sim"


def population_table(spark: SparkSession, settings: Settings) -> DataFrame:
    records = [
        {**{f.name: getattr(p, f.name, None) for f in POPULATION_SCHEMA}, "raw_file_path": p.catalogue_dir}
        for p in settings.populations
    ]
    return dimension_table(spark, records, POPULATION_SCHEMA)


def pair_table(spark: SparkSession, settings: Settings) -> DataFrame:
    """Match setups with the redshift and softening that their id encodes."""
    ids = spark.createDataFrame([(k,) for k in settings.matches], "simulation_pair_id string")
    return ids.select(
        "simulation_pair_id",
        setup_redshift("simulation_pair_id").alias("z_ini"),
        setup_softening("simulation_pair_id").alias("softening"),
    )


def split_table(spark: SparkSession, settings: Settings) -> DataFrame:
    rows = [
        (name, role, sim)
        for name, spec in settings.splits.items()
        for role, sims in (("train", spec.train), ("test", spec.test))
        for sim in sims
    ]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("split_name", "role", "simulation_id")])
    return spark.createDataFrame(rows, schema)


def validate(spark: SparkSession, settings: Settings) -> None:
    """Raise with all violated rules at once."""
    populations = population_table(spark, settings)
    listed = split_table(spark, settings)
    checks = [
        *population_rules(populations),
        parameter_rules(spark, {
            "merit_threshold": settings.merit_threshold,
            "train_fraction": settings.train_fraction,
            "val_fraction": settings.val_fraction,
        }),
        rule_references(listed, "simulation_id", populations, "simulation_id", "split names an unknown simulation"),
        rule_unique(
            listed.where(F.col("split_name") != WITHIN),
            ["split_name", "simulation_id"],
            "simulation in both train and test of a cross split",
        ),
    ]
    for name, spec in settings.splits.items():
        if not spec.train or not spec.test:
            raise ValueError(f"split {name} needs a train and a test list")
    assert_no_violations(*checks)
    pair_table(spark, settings).write.format("noop").mode("overwrite").save()
