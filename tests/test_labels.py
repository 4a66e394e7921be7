from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators import labels
from starloom.plans.layers import label_table

ALPHA, BETA, LIMIT = 0.0624, -0.0988, 10.0


def label_inputs(spark):
    pairs = spark.createDataFrame(
        [("p1", "wdm", "cdm")], "simulation_pair_id string, wdm_simulation_id string, cdm_simulation_id string"
    )
    matches = spark.createDataFrame(
        [("p1", 1, True), ("p1", 2, False)],
        "simulation_pair_id string, wdm_halo_id long, has_cdm_counterpart boolean",
    )
    protohalos = spark.createDataFrame(
        [
            (1, "wdm", "WDM", True, 0.5, 1e9),
            (2, "wdm", "WDM", True, 0.1, 1e9),
            (3, "wdm", "WDM", False, None, None),
            (4, "wdm", "WDM", True, 0.5, 1.5e10),
            (5, "cdm", "CDM", False, None, None),
        ],
        "halo_id long, simulation_id string, cosmology string, has_protohalo_data boolean, sphericity_s double, m_hmm double",
    )
    return protohalos, pairs, matches


def test_label_truth_table(spark):
    out = label_table(*label_inputs(spark), ALPHA, BETA, LIMIT).orderBy("halo_id").collect()
    got = [(r["halo_id"], r["is_spurious_empirical"], r["is_spurious_cdm_match"], r["label_agreement"]) for r in out]
    assert got == [
        (1, False, False, True),
        (2, True, True, True),
        (3, None, True, None),
        (4, False, True, False),
    ]


def test_label_table_is_repeatable(spark):
    args = (*label_inputs(spark), ALPHA, BETA, LIMIT)
    assert label_table(*args).count() == label_table(*args).count() == 4


def test_relation_on_the_limit_is_genuine(spark):
    rows = spark.createDataFrame([(True, 0.0, 1e10), (True, 0.0, 0.999e10)], "h boolean, s double, m double")
    got = rows.select(labels.relation_label(F.col("h"), F.col("s"), F.col("m"), ALPHA, BETA, 1e10)).collect()
    assert [r[0] for r in got] == [False, True]


CANDIDATES = [
    ("p", 1, 10, 0.3), ("p", 1, 11, 0.9), ("p", 1, 12, 0.9),  # tie: lower id wins
    ("p", 2, 20, 0.05), ("p", 2, 21, 0.01),  # seen, nothing passes
    ("p", 3, 30, 0.1),  # exactly on the threshold
    ("q", 1, 40, None),  # no score
]


def test_best_match(spark):
    rows = spark.createDataFrame(CANDIDATES, "pair string, parent long, cand long, merit double")
    out = labels.best_match(rows, ["pair", "parent"], "cand", "merit", 0.1).orderBy("pair", "parent").collect()
    assert [tuple(r) for r in out] == [
        ("p", 1, 11, 0.9, True),
        ("p", 2, None, None, False),
        ("p", 3, 30, 0.1, True),
        ("q", 1, None, None, False),
    ]


def test_best_match_filters_before_the_shuffle(spark):
    from conftest import plan_of

    rows = spark.createDataFrame(CANDIDATES, "pair string, parent long, cand long, merit double")
    text = plan_of(labels.best_match(rows, ["pair", "parent"], "cand", "merit", 0.1))
    assert "row_number(), 1, Partial" in text


def test_unmatched_parents(spark):
    rows = spark.createDataFrame(CANDIDATES, "pair string, parent long, cand long, merit double")
    top = labels.top_candidates(rows, ["pair", "parent"], "cand", "merit", 0.1)
    out = labels.unmatched_parents(rows, top, ["pair", "parent"])
    assert {tuple(r) for r in out.collect()} == {("p", 2), ("q", 1)}
