"""Algebraic features and the gold column layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import box_fraction, log10_positive

# Column layout of the feature table.
KEY_COLUMNS = ["halo_id", "simulation_id", "cosmology", "softening", "z_ini", "n_part_per_side"]
FEATURE_COLUMNS = [
    "log10_m200",
    "log10_npart",
    "x_norm",
    "y_norm",
    "z_norm",
    "v_disp_sigv",
    "concentration_cNFW",
    "spin_bullock",
    "axis_ratio_b_over_a",
    "axis_ratio_c_over_a",
    "sphericity_s",
    "log10_m_hmm",
    "a_hmm",
    "dist_nearest_neighbour_mpc_h",
    "count_neighbours_within_radius_mpc_h",
]
NULLABLE_FEATURES = ["sphericity_s", "log10_m_hmm", "a_hmm"]


def catalogue_features(df: DataFrame) -> DataFrame:
    """Features that follow from a row's own columns."""
    return df.withColumns({
        "log10_m200": log10_positive("m_halo_msun_h"),
        "log10_npart": log10_positive("n_particles"),
        "x_norm": box_fraction("x_kpc_h", "box_size_mpc_h"),
        "y_norm": box_fraction("y_kpc_h", "box_size_mpc_h"),
        "z_norm": box_fraction("z_kpc_h", "box_size_mpc_h"),
        "v_disp_sigv": F.col("sigma_v_km_s"),
        "concentration_cNFW": F.col("c_nfw"),
        "axis_ratio_b_over_a": F.col("axis_ratio_b"),
        "axis_ratio_c_over_a": F.col("axis_ratio_c"),
        "log10_m_hmm": log10_positive("m_hmm"),
    })
