"""Classifier metrics as aggregates over the running class totals per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.joins import materialise_small, null_safe_join
from starloom.operators.ordered import totals_by_value, value_table

# Names of the run log.
METRIC_NAMES = (
    "test_average_precision",
    "test_roc_auc",
    "test_f1",
    "test_precision",
    "test_recall",
    "test_f1_genuine",
    "test_precision_genuine",
    "test_recall_genuine",
)


def predicted_class(score: Column | str, threshold: float = 0.5) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    return (c >= F.lit(float(threshold))).cast("int")


def is_correct(truth: str, predicted: str) -> Column:
    return (F.col(truth) == F.col(predicted)).cast("int")


def score_totals(df: DataFrame, truth: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Per group and distinct score, highest first: positives, negatives and their running totals."""
    return totals_by_value(class_counts(df, truth, score, group), score, ["tp", "fp"], group, descending=True)


def class_counts(df: DataFrame, truth: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Stored positives and negatives per group and distinct score."""
    y = F.col(truth).cast("int")
    return value_table(df, score, {"tp": (y == 1).cast("bigint"), "fp": (y == 0).cast("bigint")}, group)


def ranking_metrics(df: DataFrame, truth: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision and ROC area (ties count half) per group."""
    totals = score_totals(df, truth, score, group)
    positives, negatives = F.sum("tp"), F.sum("fp")
    steps = F.sum(F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")).cast("double"))
    area = F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / F.lit(2.0)))
    return totals.groupBy(*group).agg(
        F.coalesce(F.try_divide(steps, positives), F.lit(0.0)).alias("average_precision"),
        F.try_divide(area, positives.cast("double") * negatives).alias("roc_auc"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def threshold_metrics(
    df: DataFrame, truth: str, predicted: str, group: Sequence[str] = ()
) -> DataFrame:
    """F1, precision and recall of both classes; zero where a denominator is zero."""
    y, p = F.col(truth), F.col(predicted)
    tp, tn = F.count_if((y == 1) & (p == 1)), F.count_if((y == 0) & (p == 0))
    fp, fn = F.count_if((y == 0) & (p == 1)), F.count_if((y == 1) & (p == 0))
    return df.groupBy(*group).agg(
        _ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("test_f1"),
        _ratio(tp, tp + fp).alias("test_precision"),
        _ratio(tp, tp + fn).alias("test_recall"),
        _ratio(F.lit(2) * tn, F.lit(2) * tn + fp + fn).alias("test_f1_genuine"),
        _ratio(tn, tn + fn).alias("test_precision_genuine"),
        _ratio(tn, tn + fp).alias("test_recall_genuine"),
    )


def compute_metrics(
    df: DataFrame, truth: str, score: str, group: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """All eight metrics, one row per group, from one aggregate over the score totals."""
    totals = score_totals(df, truth, score, group)
    hit = F.col(score) >= F.lit(float(threshold))
    pos, neg = F.sum("tp"), F.sum("fp")
    tp = F.coalesce(F.sum(F.when(hit, F.col("tp"))), F.lit(0))
    fp = F.coalesce(F.sum(F.when(hit, F.col("fp"))), F.lit(0))
    fn, tn = pos - tp, neg - fp
    steps = F.sum(F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")).cast("double"))
    area = F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / F.lit(2.0)))
    values = [
        F.coalesce(F.try_divide(steps, pos), F.lit(0.0)),
        F.try_divide(area, pos.cast("double") * neg),
        _ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn),
        _ratio(tp, tp + fp),
        _ratio(tp, tp + fn),
        _ratio(F.lit(2) * tn, F.lit(2) * tn + fp + fn),
        _ratio(tn, tn + fn),
        _ratio(tn, tn + fp),
    ]
    return totals.groupBy(*group).agg(*[v.alias(n) for v, n in zip(values, METRIC_NAMES, strict=True)])


def pr_roc_curves(df: DataFrame, truth: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score: precision, recall, false-positive rate, and the prevalence."""
    group = list(group)
    counts = class_counts(df, truth, score, group)
    totals = totals_by_value(counts, score, ["tp", "fp"], group, descending=True)
    sizes, _ = materialise_small(counts.groupBy(*group).agg(F.sum("tp").alias("__p"), F.sum("fp").alias("__n")))
    if group:
        joined = null_safe_join(totals, sizes, group)
    else:
        joined = totals.withColumns({c: sizes.select(c).scalar() for c in ("__p", "__n")})
    p, n = F.col("__p").cast("double"), F.col("__n").cast("double")
    return joined.select(
        *group,
        score,
        (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")).cast("double")).alias("precision"),
        F.try_divide(F.col("cum_tp").cast("double"), p).alias("recall"),
        F.try_divide(F.col("cum_fp").cast("double"), n).alias("fpr"),
        F.try_divide(p, p + n).alias("prevalence"),
    )


def confusion_matrix(df: DataFrame, truth: str, predicted: str, group: Sequence[str] = ()) -> DataFrame:
    """All four cells per group with the share of the true class; empty cells appear as zero."""
    y, p = F.col(truth), F.col(predicted)
    cells = [(t, q) for t in (0, 1) for q in (0, 1)]
    counted = df.groupBy(*group).agg(
        *[F.count_if((y == t) & (p == q)).alias(f"__{t}{q}") for t, q in cells]
    )
    rows = F.array(*[
        F.struct(
            F.lit(t).alias("actual"),
            F.lit(q).alias("predicted"),
            F.col(f"__{t}{q}").alias("n"),
            _ratio(F.col(f"__{t}{q}"), F.col(f"__{t}0") + F.col(f"__{t}1")).alias("row_share"),
        )
        for t, q in cells
    ])
    return counted.select(*group, F.inline(rows))
