"""Files to gold tables on a small made-up catalogue."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from conftest import plan_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from starloom.operators import profile, quality
from starloom.operators.features import FEATURE_COLUMNS, KEY_COLUMNS
from starloom.plans import layers
from starloom.plans.settings import Population, Settings, SplitSpec, validate
from starloom.plans.training import assemble

COLUMNS = ["ID", "hostHalo", "numSubStruct", "npart", "Mhalo", "Xc", "Yc", "Zc", "sigV", "lambda", "b", "c", "n_gas", "M_gas", "cNFW"]
SIMS = [(f"{c}_{z}_{s}", c.upper(), s, z) for c in ("cdm", "wdm") for z, s in ((39, "fixed"), (39, "adaptive"), (99, "fixed"))]
PAIRS = {"z39_fixed": (39, "fixed"), "z39_adapt": (39, "adaptive"), "z99_fixed": (99, "fixed")}
N = 60


@pytest.fixture(scope="module")
def settings(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(5)
    populations = []
    for sim, cosmology, softening, z in SIMS:
        folder = root / sim
        folder.mkdir()
        lines = ["#" + "\t".join(f"{c}({i + 1})" for i, c in enumerate(COLUMNS)) + "\t"]
        for h in range(N):
            x, y, w = (rng.random(3) * 25_000).round(3)
            lines.append("\t".join(map(str, [
                h + 1, 0 if h % 4 else 1, 0, 50 + 10 * h, f" {10 ** (8.5 + h / 20):.6e}", x, y, w, 30.5 + h, 0.03, 0.8, 0.6, 0, 0.0, 9.5,
            ])) + "\t")
        (folder / f"{sim}.AHF_halos").write_text("\n".join(lines) + "\n")
        shapes = [
            (h + 1, 0.1 + 0.01 * h, f"snap_0{40 + h % 10}-z{h % 3}.000", 10 ** (8.0 + h / 20)) for h in range(N) if h % 3
        ]
        path = str(root / f"{sim}.parquet")
        spark.createDataFrame(
            shapes, "halo_id long, sphericity_halfmaxmass double, halfmaxmass string, mhalo_halfmaxmass double"
        ).write.parquet(path)
        populations.append(Population(sim, cosmology, softening, 512, z, 25.0, 1e7, str(folder), path))
    matches = {}
    for pair in PAIRS:
        folder = root / "match" / pair
        folder.mkdir(parents=True)
        lines = ["# matches"]
        for h in range(0, N, 2):
            lines += [f"{h + 1}  {50 + 10 * h}  2", f"  9  {h + 1}  40  {0.02 + h / 100:.3f}", f"  3  {h + 2}  40  0.010"]
        (folder / f"{pair}_croco").write_text("\n".join(lines) + "\n")
        matches[pair] = str(folder)
    base = "wdm_39_fixed"
    splits = {
        "within_sim": SplitSpec((base,), (base,)),
        "cross_softening": SplitSpec((base,), ("wdm_39_adaptive",)),
        "cross_z_ini": SplitSpec((base,), ("wdm_99_fixed",)),
    }
    return Settings(tuple(populations), matches, splits, layers=("p_bronze", "p_silver", "p_gold"))


@pytest.fixture(scope="module")
def built(spark, settings):
    layers.build_bronze(spark, settings)
    silver = layers.build_silver(spark, settings)
    gold = layers.build_gold(spark, settings)
    return silver, gold


def test_row_counts(spark, settings, built):
    got = {r["table_name"]: r["n_rows"] for r in layers.layer_row_counts(spark, settings).collect()}
    assert got == {
        "p_bronze.simulations": 6, "p_bronze.ahf_halos": 6 * N, "p_bronze.protohalo_shapes": 6 * 40,
        "p_bronze.wdm_cdm_matches": 3 * N, "p_silver.halos": 6 * N, "p_silver.protohalos": 6 * N,
        "p_silver.wdm_cdm_matches": 3 * N // 2, "p_silver.simulation_pairs": 3, "p_gold.labels": 3 * N,
        "p_gold.features": 6 * N, "p_gold.train_test_splits": 5 * N,
    }


def test_rates_seen_while_writing(built):
    silver, gold = built
    assert silver["shape_coverage"]["n_hit"] == 240 and silver["shape_coverage"]["n_total"] == 360
    assert silver["match_rate"]["n_hit"] == 3 * 26
    assert gold["pct_hit"] == pytest.approx(100 / 3)


def test_silver_columns(spark, built):
    halos = spark.table("p_silver.halos")
    assert not {"n_gas", "M_gas"} & set(halos.columns)
    assert {"m_halo_msun_h", "is_host", "is_subhalo", "below_100_part_limit", "box_size_mpc_h"} <= set(halos.columns)
    row = halos.where("simulation_id = 'wdm_39_fixed' and halo_id = 5").first()
    assert (row["is_host"], row["is_subhalo"], row["below_100_part_limit"], row["cosmology"]) == (False, True, True, "WDM")


def test_pairs(spark, built):
    got = {(r["simulation_pair_id"], r["wdm_simulation_id"], r["cdm_simulation_id"], r["z_ini"]) for r in spark.table("p_silver.simulation_pairs").collect()}
    assert got == {(p, f"wdm_{z}_{s}", f"cdm_{z}_{s}", z) for p, (z, s) in PAIRS.items()}


def test_labels(spark, built):
    labels = spark.table("p_gold.labels")
    got = {r["halo_id"]: r for r in labels.where("simulation_id = 'wdm_39_fixed'").collect()}
    for h in range(N):
        row = got[h + 1]
        assert row["is_spurious_cdm_match"] == (h % 2 == 1 or 0.02 + h / 100 < 0.1 - 1e-12)
        if h % 3 == 0:
            assert row["is_spurious_empirical"] is None and row["label_agreement"] is None
        else:
            mass = 10 ** (8.0 + h / 20)
            want = mass < 1e10 and 0.1 + 0.01 * h < 0.0624 * np.log10(mass) - 0.0988
            assert row["is_spurious_empirical"] == want
    assert labels.where("simulation_id like 'cdm%'").count() == 0


def test_features(spark, built):
    features = spark.table("p_gold.features")
    assert features.columns == KEY_COLUMNS + FEATURE_COLUMNS
    nulls = {r["feature"]: r["n_null"] for r in profile.null_profile(features, FEATURE_COLUMNS).collect()}
    assert {k: v for k, v in nulls.items() if v} == {"sphericity_s": 120, "log10_m_hmm": 120, "a_hmm": 120}
    bounds = features.agg(F.min("x_norm"), F.max("x_norm"), F.min("dist_nearest_neighbour_mpc_h")).first()
    assert 0 <= bounds[0] < bounds[1] < 1 and bounds[2] > 0


def test_splits(spark, built):
    splits = spark.table("p_gold.train_test_splits")
    got = {(r["split_name"], r["split_role"]): r["count"] for r in splits.groupBy("split_name", "split_role").count().collect()}
    assert got == {
        ("within_sim", "train"): 36, ("within_sim", "val"): 12, ("within_sim", "test"): 12,
        ("cross_softening", "train"): 48, ("cross_softening", "val"): 12, ("cross_softening", "test"): 60,
        ("cross_z_ini", "train"): 48, ("cross_z_ini", "val"): 12, ("cross_z_ini", "test"): 60,
    }
    assert quality.duplicate_keys(splits, ["split_name", "halo_id", "simulation_id"]).count() == 0


def test_training_rows(spark, built):
    rows = assemble(
        spark.table("p_gold.features"), spark.table("p_gold.labels"), spark.table("p_gold.train_test_splits"), "cross_z_ini",
        extra=spark.table("p_silver.halos").select("halo_id", "simulation_id", "is_host"),
    )
    assert rows.count() == 120
    assert {"label", "split_role", "is_host", *FEATURE_COLUMNS} <= set(rows.columns)


def test_building_again_changes_nothing(spark, settings, built):
    before = spark.table("p_gold.labels").collect()
    layers.build_silver(spark, settings)
    layers.build_gold(spark, settings)
    assert sorted(map(str, before)) == sorted(map(str, spark.table("p_gold.labels").collect()))


def test_bucketed_layers_join_without_a_shuffle(spark, settings):
    bucketed = replace(settings, layers=("b_bronze", "b_silver", "b_gold"), buckets=4)
    layers.build_bronze(spark, bucketed)
    layers.build_silver(spark, bucketed)
    layers.build_gold(spark, bucketed)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = assemble(*[spark.table(f"b_gold.{t}") for t in ("features", "labels", "train_test_splits")], "cross_z_ini")
        text = plan_of(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert text.count("SortMergeJoin") == 2 and "Exchange" not in text
    assert "EqualTo(split_name,cross_z_ini)" in text
    assert rows.count() == 120


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"merit_threshold": 1.0}, "merit_threshold"),
        ({"train_fraction": 0.9, "val_fraction": 0.2}, "below 1|< 1"),
        ({"splits": {"within_sim": SplitSpec((), ("wdm_39_fixed",))}}, "train and a test"),
        ({"splits": {"cross_z_ini": SplitSpec(("nope",), ("wdm_39_fixed",))}}, "unknown simulation"),
        ({"splits": {"cross_z_ini": SplitSpec(("wdm_39_fixed",), ("wdm_39_fixed",))}}, "both train and test"),
    ],
)
def test_settings_are_checked(spark, settings, change, message):
    with pytest.raises(ValueError, match=message):
        validate(spark, replace(settings, **change))


def test_population_rules(spark, settings):
    first = settings.populations[0]
    for bad, message in [
        (replace(first, cosmology="HDM"), "cosmology"),
        (replace(first, simulation_id=settings.populations[1].simulation_id), "duplicate"),
        (replace(first, softening="soft"), "softening"),
    ]:
        changed = replace(settings, populations=(bad, *settings.populations[1:]))
        with pytest.raises(ValueError, match=message):
            validate(spark, changed)


def test_setup_ids_are_checked(spark, settings):
    with pytest.raises(PySparkException, match="setup id"):
        validate(spark, replace(settings, matches={"39_fixed": "x"}))


def test_pair_without_partner_raises(spark, built):
    sims = spark.table("p_bronze.simulations").where("simulation_id <> 'cdm_39_fixed'")
    pairs = spark.createDataFrame([("z39_fixed", 39, "fixed")], "simulation_pair_id string, z_ini int, softening string")
    with pytest.raises(PySparkException, match="1 WDM and 0 CDM"):
        layers.simulation_pairs(sims, pairs).collect()
