"""Bronze, silver and gold tables of the catalogue pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.clean import (
    below_limit,
    coverage_join,
    drop_present,
    enrich,
    host_flags,
    pair_bridge,
    rename_present,
)
from starloom.operators.features import FEATURE_COLUMNS, KEY_COLUMNS, catalogue_features
from starloom.operators.labels import (
    absence_label,
    agreement,
    best_match,
    join_through_bridge,
    relation_label,
)
from starloom.operators.quality import row_counts, written_rate
from starloom.operators.sampling import cross_population_split, stratified_three_way
from starloom.operators.spatial import periodic_neighbours
from starloom.plans.settings import WITHIN, Settings, pair_table, population_table, validate
from starloom.sources.shapes import read_shapes
from starloom.sources.tables import create_layers, replace_table, table_folder
from starloom.sources.text import CATALOGUE_GLOB, MATCH_GLOB, one_file_each, read_catalogue, read_matches

# Catalogue columns that are renamed, dropped, and joined in.
RENAMES = {
    "hostHalo": "host_halo_id",
    "numSubStruct": "n_substructure",
    "Mhalo": "m_halo_msun_h",
    "npart": "n_particles",
    "Xc": "x_kpc_h",
    "Yc": "y_kpc_h",
    "Zc": "z_kpc_h",
    "VXc": "vx_km_s",
    "VYc": "vy_km_s",
    "VZc": "vz_km_s",
    "Rhalo": "r_halo_kpc_h",
    "Rmax": "r_max_kpc_h",
    "r2": "r_scale_kpc_h",
    "mbp_offset": "mbp_offset_kpc_h",
    "com_offset": "com_offset_kpc_h",
    "Vmax": "v_max_km_s",
    "v_esc": "v_esc_km_s",
    "sigV": "sigma_v_km_s",
    "lambda": "spin_bullock",
    "lambdaE": "spin_peebles",
    "Lx": "l_x",
    "Ly": "l_y",
    "Lz": "l_z",
    "b": "axis_ratio_b",
    "c": "axis_ratio_c",
    "Eax": "ea_x",
    "Eay": "ea_y",
    "Eaz": "ea_z",
    "Ebx": "eb_x",
    "Eby": "eb_y",
    "Ebz": "eb_z",
    "Ecx": "ec_x",
    "Ecy": "ec_y",
    "Ecz": "ec_z",
    "ovdens": "overdensity",
    "nbins": "n_bins",
    "fMhires": "f_mass_highres",
    "Ekin": "e_kin_msun_km2_s2_h",
    "Epot": "e_pot_msun_km2_s2_h",
    "SurfP": "surf_pressure_msun_km2_s2_h",
    "Phi0": "phi0_km2_s2",
    "cNFW": "c_nfw",
}
DROPPED = (
    "n_gas",
    "M_gas",
    "lambda_gas",
    "lambdaE_gas",
    "Lx_gas",
    "Ly_gas",
    "Lz_gas",
    "b_gas",
    "c_gas",
    "Eax_gas",
    "Eay_gas",
    "Eaz_gas",
    "Ebx_gas",
    "Eby_gas",
    "Ebz_gas",
    "Ecx_gas",
    "Ecy_gas",
    "Ecz_gas",
    "Ekin_gas",
    "Epot_gas",
    "n_star",
    "M_star",
    "lambda_star",
    "lambdaE_star",
    "Lx_star",
    "Ly_star",
    "Lz_star",
    "b_star",
    "c_star",
    "Eax_star",
    "Eay_star",
    "Eaz_star",
    "Ebx_star",
    "Eby_star",
    "Ebz_star",
    "Ecx_star",
    "Ecy_star",
    "Ecz_star",
    "Ekin_star",
    "Epot_star",
    "mean_z_gas",
    "mean_z_star",
    "n_star_excised",
    "M_star_excised",
    "mean_z_star_excised",
)
POPULATION_ATTRIBUTES = [
    "cosmology", "softening", "n_part_per_side", "z_ini", "box_size_mpc_h", "particle_mass_msun_h",
]
PARTICLE_LIMIT = 100
KEY = ["halo_id", "simulation_id"]


def build_bronze(spark: SparkSession, settings: Settings) -> dict[str, DataFrame]:
    """Four raw tables, each from one scan over all its files."""
    validate(spark, settings)
    bronze = settings.layers[0]
    create_layers(spark, settings.layers)
    catalogues = one_file_each(
        spark, {p.simulation_id: p.catalogue_dir for p in settings.populations}, CATALOGUE_GLOB
    )
    matches = one_file_each(spark, settings.matches, MATCH_GLOB)
    shapes = {p.simulation_id: p.shapes_path for p in settings.populations}
    tables = {
        "simulations": population_table(spark, settings),
        "ahf_halos": read_catalogue(spark, catalogues),
        "protohalo_shapes": read_shapes(spark, shapes),
        "wdm_cdm_matches": read_matches(spark, matches),
    }
    keyed = {"ahf_halos", "protohalo_shapes"}
    return {
        k: replace_table(df, f"{bronze}.{k}", KEY, settings.buckets if k in keyed else 0)
        for k, df in tables.items()
    }


def clean_catalogue(halos: DataFrame, simulations: DataFrame) -> DataFrame:
    kept = host_flags(rename_present(drop_present(halos, DROPPED), RENAMES), "host_halo_id")
    flagged = kept.withColumn("below_100_part_limit", below_limit(F.col("n_particles"), PARTICLE_LIMIT))
    return enrich(flagged, simulations, "simulation_id", POPULATION_ATTRIBUTES)


def with_shapes(halos: DataFrame, shapes: DataFrame) -> DataFrame:
    return coverage_join(
        halos, shapes, KEY, ["sphericity_s", "a_hmm", "m_hmm"], "sphericity_s", "has_protohalo_data"
    )


def reduce_matches(matches: DataFrame, threshold: float) -> DataFrame:
    return best_match(
        matches,
        ["simulation_pair_id", "wdm_halo_id"],
        "cdm_halo_id",
        "merit",
        threshold,
        found="has_cdm_counterpart",
        best_candidate="best_cdm_halo_id",
        best_score="best_merit",
    )


def simulation_pairs(simulations: DataFrame, pairs: DataFrame) -> DataFrame:
    typed = simulations.withColumn("z_ini", F.col("z_ini").cast("int"))
    return pair_bridge(
        typed, pairs, "simulation_pair_id", ["z_ini", "softening"], "simulation_id", "cosmology",
        "WDM", "CDM", "wdm_simulation_id", "cdm_simulation_id", carry=["n_part_per_side"],
    )


def _rate(spark: SparkSession, name: str, column: str, filled: bool = True) -> dict[str, float]:
    """Rows of a written table by whether a column is filled, from the counts its writer left in the files."""
    return written_rate(spark, table_folder(spark, name), column, filled).first().asDict()


def build_silver(spark: SparkSession, settings: Settings) -> dict[str, dict[str, float]]:
    """Clean tables; returns the shape coverage and the match rate."""
    bronze, silver, _ = settings.layers
    create_layers(spark, [silver])
    simulations = spark.table(f"{bronze}.simulations")
    halos = replace_table(
        clean_catalogue(spark.table(f"{bronze}.ahf_halos"), simulations), f"{silver}.halos", KEY, settings.buckets
    )
    replace_table(
        with_shapes(halos, spark.table(f"{bronze}.protohalo_shapes")), f"{silver}.protohalos", KEY, settings.buckets
    )
    replace_table(
        reduce_matches(spark.table(f"{bronze}.wdm_cdm_matches"), settings.merit_threshold),
        f"{silver}.wdm_cdm_matches",
    )
    replace_table(simulation_pairs(simulations, pair_table(spark, settings)), f"{silver}.simulation_pairs")
    return {
        "shape_coverage": _rate(spark, f"{silver}.protohalos", "sphericity_s"),
        "match_rate": _rate(spark, f"{silver}.wdm_cdm_matches", "best_cdm_halo_id"),
    }


def label_table(
    protohalos: DataFrame, pairs: DataFrame, matches: DataFrame, alpha: float, beta: float, mass_threshold_log10: float
) -> DataFrame:
    """Both labels of every WDM object; other populations have no row."""
    objects = protohalos.where(F.col("cosmology") == "WDM").select(
        *KEY, "has_protohalo_data", "sphericity_s", "m_hmm"
    )
    joined = join_through_bridge(
        objects, pairs, matches, "simulation_id", "wdm_simulation_id", "simulation_pair_id",
        "halo_id", "wdm_halo_id", "has_cdm_counterpart",
    )
    labelled = joined.select(
        *KEY,
        relation_label(
            F.col("has_protohalo_data"), F.col("sphericity_s"), F.col("m_hmm"),
            alpha, beta, 10.0**mass_threshold_log10,
        ).alias("is_spurious_empirical"),
        absence_label(F.col("has_cdm_counterpart")).alias("is_spurious_cdm_match"),
    )
    return labelled.withColumn(
        "label_agreement", agreement(F.col("is_spurious_empirical"), F.col("is_spurious_cdm_match"))
    )


def feature_table(protohalos: DataFrame, radius: float) -> DataFrame:
    """All 15 features of every object."""
    metres = {f"{axis}_mpc": F.col(f"{axis}_kpc_h") / F.lit(1000.0) for axis in "xyz"}
    positions = protohalos.select(*KEY, "box_size_mpc_h", *[c.alias(k) for k, c in metres.items()])
    spatial = periodic_neighbours(
        positions,
        "simulation_id",
        ["halo_id"],
        list(metres),
        "box_size_mpc_h",
        radius,
        nearest_name="dist_nearest_neighbour_mpc_h",
        count_name="count_neighbours_within_radius_mpc_h",
    )
    return (
        catalogue_features(protohalos).join(spatial, KEY, "left").select(*KEY_COLUMNS, *FEATURE_COLUMNS)
    )


def split_assignments(labels: DataFrame, settings: Settings) -> DataFrame:
    """Role of every labelled object in every scenario."""
    labelled = labels.where(F.col("is_spurious_cdm_match").isNotNull()).select(*KEY, "is_spurious_cdm_match")
    parts = []
    for name, spec in settings.splits.items():
        if name == WITHIN:
            inside = labelled.where(F.col("simulation_id").isin(*spec.train, *spec.test))
            placed = stratified_three_way(
                inside, "is_spurious_cdm_match", KEY, settings.random_seed,
                settings.train_fraction, settings.val_fraction,
            )
        else:
            placed = cross_population_split(
                labelled, "simulation_id", spec.train, spec.test,
                "is_spurious_cdm_match", KEY, settings.random_seed, settings.val_fraction,
            )
        parts.append(placed.select(F.lit(name).alias("split_name"), *KEY, "split_role"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def build_gold(spark: SparkSession, settings: Settings) -> dict[str, float]:
    """Labels, features and split roles; returns the share of features without shape data."""
    _, silver, gold = settings.layers
    create_layers(spark, [gold])
    protohalos = spark.table(f"{silver}.protohalos")
    labels = replace_table(
        label_table(
            protohalos,
            spark.table(f"{silver}.simulation_pairs"),
            spark.table(f"{silver}.wdm_cdm_matches"),
            settings.alpha,
            settings.beta,
            settings.mass_threshold_log10,
        ),
        f"{gold}.labels",
        KEY,
        settings.buckets,
    )
    replace_table(
        feature_table(protohalos, settings.neighbour_radius_mpc_h), f"{gold}.features", KEY, settings.buckets
    )
    replace_table(
        split_assignments(labels, settings), f"{gold}.train_test_splits", KEY, settings.buckets
    )
    return _rate(spark, f"{gold}.features", "sphericity_s", filled=False)


def layer_row_counts(spark: SparkSession, settings: Settings) -> DataFrame:
    bronze, silver, gold = settings.layers
    names = {
        bronze: ["simulations", "ahf_halos", "protohalo_shapes", "wdm_cdm_matches"],
        silver: ["halos", "protohalos", "wdm_cdm_matches", "simulation_pairs"],
        gold: ["labels", "features", "train_test_splits"],
    }
    return row_counts({f"{layer}.{t}": spark.table(f"{layer}.{t}") for layer, ts in names.items() for t in ts})
