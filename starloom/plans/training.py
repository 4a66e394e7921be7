"""Training set assembly and the model sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.features import FEATURE_COLUMNS, NULLABLE_FEATURES
from starloom.operators.models import (
    BUILDERS,
    NETWORKS,
    Fitted,
    Roles,
    network_inputs,
    positive_probability,
    prepared,
    save_model,
    select_names,
    soft_vote,
    test_metrics,
    train_network,
    tune,
)
from starloom.sources.runs import append_run, run_row

KEY = ["halo_id", "simulation_id"]


def assemble(
    features: DataFrame,
    labels: DataFrame,
    splits: DataFrame,
    split: str,
    key: Sequence[str] = KEY,
    label: str = "is_spurious_cdm_match",
    columns: Sequence[str] = FEATURE_COLUMNS,
    extra: DataFrame | None = None,
) -> DataFrame:
    """Features, label and role of one scenario; ``extra`` joins further columns by key."""
    roles = splits.where(F.col("split_name") == split).select(*key, "split_role")
    known = labels.where(F.col(label).isNotNull()).select(*key, label)
    joined = features.select(*key, *columns).join(known, list(key)).join(roles, list(key))
    if extra is not None:
        joined = joined.join(extra, list(key))
    carried = [] if extra is None else [c for c in extra.columns if c not in key]
    return prepared(joined, columns, label, [*key, *carried, "split_role"])


def train_split(
    rows: DataFrame,
    split: str,
    models: str | Sequence[str] = "all",
    networks: str | Sequence[str] = "all",
    columns: Sequence[str] = FEATURE_COLUMNS,
    nullable: Sequence[str] = NULLABLE_FEATURES,
    key: Sequence[str] = KEY,
    grids: dict[str, dict[str, list]] | None = None,
    iterations: dict[str, int] | None = None,
    runs_table: str | None = None,
    model_dir: str | None = None,
    parallelism: int = 1,
) -> dict[str, tuple[dict, dict[str, float]]]:
    """Tune, refit and score the chosen models on one scenario.

    The soft-voting ensemble is scored when all three base models were trained. Returns parameters
    and test metrics per model; with ``runs_table`` each run is appended to the log as it finishes,
    with ``model_dir`` the fitted models are saved. ``iterations`` has other limits for the networks:
    ``max_iterations``, ``every`` and ``patience``.
    """
    base_names = select_names(models, list(BUILDERS)) if models else []
    network_names = select_names(networks, list(NETWORKS)) if networks else []
    rows = rows.persist()
    try:
        roles = Roles.of(rows)
        out: dict[str, tuple[dict, dict[str, float]]] = {}

        def finish(name: str, params: dict, scored: DataFrame, fitted: Fitted | None) -> None:
            metrics = test_metrics(scored)
            out[name] = (params, metrics)
            if runs_table:
                append_run(run_row(rows.sparkSession, name, split, params, metrics), runs_table)
            if model_dir and fitted:
                save_model(fitted.model, f"{model_dir}/{name}_{split}")

        fitted: dict[str, Fitted] = {}
        for name in base_names:
            fitted[name] = tune(name, roles, columns, (grids or {}).get(name), parallelism)
            finish(name, fitted[name].params, positive_probability(fitted[name].model, roles.test), fitted[name])
        if set(fitted) == set(BUILDERS):
            vote = soft_vote({k: f.model for k, f in fitted.items()}, roles.test)
            finish("ensemble", {"voting": "soft"}, vote, None)
        for name in network_names:
            trained = train_network(name, roles, columns, nullable, key, **(iterations or {}))
            test, _ = network_inputs(roles.test, columns, nullable, NETWORKS[name])
            finish(name, trained.params, positive_probability(trained.model, test), trained)
        return out
    finally:
        rows.unpersist()


def train_all(
    features: DataFrame, labels: DataFrame, splits: DataFrame, split: str | Sequence[str], known: Sequence[str], **options
) -> dict[str, dict[str, tuple[dict, dict[str, float]]]]:
    """The sweep over scenarios: ``"all"`` or chosen names of ``known``."""
    return {
        name: train_split(assemble(features, labels, splits, name), name, **options)
        for name in select_names(split, known)
    }
