"""Grouped profiles: counts, rates, coverage, null shares, binned rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions import bin_index, percent, quantise
from starloom.operators.ordered import usable


def group_count(df: DataFrame, group: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias(name))


def score_summary(df: DataFrame, group: Sequence[str], value: str, prefix: str, n: str = "n") -> DataFrame:
    """Row count, minimum, mean and maximum of one column per group."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias(n),
        F.min(value).alias(f"{prefix}_min"),
        F.avg(value).alias(f"{prefix}_mean"),
        F.max(value).alias(f"{prefix}_max"),
    )


def conditional_counts(
    df: DataFrame, group: Sequence[str], conditions: dict[str, Column], total: str | None = "n"
) -> DataFrame:
    """Row count plus one count per condition; NULL conditions do not count."""
    aggs = [F.count(F.lit(1)).alias(total)] if total else []
    return df.groupBy(*group).agg(*aggs, *[F.count_if(c).alias(k) for k, c in conditions.items()])


def value_bounds(df: DataFrame, group: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Minimum and maximum per group; ``columns`` maps a column to the output prefix."""
    aggs = []
    for column, prefix in columns.items():
        aggs += [F.min(column).alias(f"{prefix}_min"), F.max(column).alias(f"{prefix}_max")]
    return df.groupBy(*group).agg(*aggs)


def coverage(
    df: DataFrame, group: Sequence[str], flag: str, total: str, with_name: str, without_name: str, share: str
) -> DataFrame:
    """Rows with and without a flag per group, and the share with it."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias(total),
        F.count_if(F.col(flag)).alias(with_name),
        F.count_if(~F.col(flag)).alias(without_name),
        (F.count_if(F.col(flag)) / F.count(F.lit(1)).cast("double")).alias(share),
    )


def label_counts(
    df: DataFrame, group: Sequence[str], match_label: str, relation_label: str, agree: str
) -> DataFrame:
    """Both labels and their agreement per group, in one aggregate."""
    m, e, a = F.col(match_label), F.col(relation_label), F.col(agree)
    n = F.count(F.lit(1))
    return df.groupBy(*group).agg(
        n.alias("n_objects"),
        F.count_if(m).alias("match_positive"),
        F.count_if(~m).alias("match_negative"),
        percent(F.count_if(m), n).alias("pct_match_positive"),
        F.count_if(e).alias("relation_positive"),
        F.count_if(~e).alias("relation_negative"),
        F.count_if(e.isNull()).alias("relation_null"),
        F.count_if(a).alias("labels_agree"),
        F.count_if(~a).alias("labels_disagree"),
        F.count_if(a.isNull()).alias("agreement_null"),
    )


def label_totals(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Positive, negative and NULL rows of several boolean columns, one row per column."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for name in labels:
        aggs += [F.count_if(F.col(name)).alias(f"{name}__p"), F.count_if(~F.col(name)).alias(f"{name}__m")]
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("label"),
            F.col(f"{name}__p").alias("n_positive"),
            F.col(f"{name}__m").alias("n_negative"),
            (F.col("__n") - F.col(f"{name}__p") - F.col(f"{name}__m")).alias("n_null"),
        )
        for name in labels
    ])
    return df.agg(*aggs).select(F.inline(rows))


def population_summary(
    df: DataFrame, group: Sequence[str], label: str, kind: str, kinds: dict[str, str], over: str
) -> DataFrame:
    """Rows per kind and label, and the positive share relative to one kind's rows.

    ``kinds`` maps a kind value to its count name; ``over`` is the kind used as denominator, and the
    share is NULL for a group without rows of that kind.
    """
    counts = {name: F.count_if(F.col(kind) == value) for value, name in kinds.items()}
    positive = F.count_if(F.col(label))
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_objects"),
        *[c.alias(name) for name, c in counts.items()],
        positive.alias("n_positive"),
        F.count_if(~F.col(label)).alias("n_negative"),
        percent(positive, F.nullif(counts[kinds[over]], F.lit(0))).alias("pct_positive"),
    )


def class_balance(df: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """Rows, positives, negatives and the positive percentage per group."""
    n = F.count(F.lit(1))
    return df.groupBy(*group).agg(
        n.alias("n_objects"),
        F.count_if(F.col(label)).alias("n_positive"),
        F.count_if(~F.col(label)).alias("n_negative"),
        percent(F.count_if(F.col(label)), n).alias("pct_positive"),
    )


def mean_profile(df: DataFrame, group: Sequence[str], digits: dict[str, int], n: str = "n") -> DataFrame:
    """Quantised means of several columns per group."""
    return df.groupBy(*group).agg(
        *[quantise(F.avg(c), d).alias(f"mean_{c}") for c, d in digits.items()],
        F.count(F.lit(1)).alias(n),
    )


def mean_and_spread(df: DataFrame, group: Sequence[str], digits: dict[str, int], n: str = "n") -> DataFrame:
    """Quantised mean and sample standard deviation of several columns per group."""
    aggs = []
    for column, d in digits.items():
        aggs += [
            quantise(F.avg(column), d).alias(f"mean_{column}"),
            quantise(F.stddev_samp(column), d).alias(f"std_{column}"),
        ]
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias(n), *aggs)


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL count and share of many columns, from one scan, one output row per column."""
    counted = df.agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.col("__n").alias("n_total"),
            F.col(c).alias("n_null"),
            F.try_divide(F.col(c).cast("double"), F.col("__n")).alias("null_frac"),
        )
        for c in columns
    ])
    return counted.select(F.inline(rows))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two labels where both are present, with the percentage of all such rows."""
    counts = (
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(a, b)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # The counts have at most as many rows as there are label combinations, so one task can sum them.
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", F.lit(100.0) * F.col("n") / whole)


def agreement_breakdown(df: DataFrame, group: Sequence[str], label: str, agree: str) -> DataFrame:
    """Agreeing positives, disagreements, agreeing negatives and undecided rows per group."""
    a, m = F.col(agree), F.col(label)
    return df.groupBy(*group).agg(
        F.count_if(a & m).alias("agree_positive"),
        F.count_if(~a).alias("disagree"),
        F.count_if(a & ~m).alias("agree_negative"),
        F.count_if(a.isNull()).alias("null_agreement"),
    )


def null_rate_by_floor(df: DataFrame, group: Sequence[str], value: str, tested: str, floor_name: str) -> DataFrame:
    """NULL share of one column per unit bin of another."""
    missing = F.count_if(F.col(tested).isNull())
    return df.groupBy(*group, F.floor(F.col(value)).alias(floor_name)).agg(
        missing.alias("n_null"),
        F.count_if(F.col(tested).isNotNull()).alias("n_non_null"),
        (missing / F.count(F.lit(1)).cast("double")).alias("null_frac"),
    )


def rate_per_bin(df: DataFrame, value: str, flag: str, bins: int) -> DataFrame:
    """Share of a flag per equal-width bin between the data's minimum and maximum.

    Bins are half open on the right without exception, so rows equal to the maximum are in no bin.
    """
    clean = df.where(usable(value))
    low, high = clean.agg(F.min(value)).scalar(), clean.agg(F.max(value)).scalar()
    return (
        clean.select(
            bin_index(F.col(value).cast("double"), low.cast("double"), high.cast("double"), bins).alias("bin"),
            F.col(flag).cast("double").alias("f")
        )
        .where(F.col("bin").between(0, bins - 1))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("rate"))
    )


def binned_error_rates(
    df: DataFrame,
    value: str,
    truth: str,
    predicted: str,
    low: float,
    high: float,
    bins: int,
    min_rows: int = 5,
    group: Sequence[str] = (),
) -> DataFrame:
    """False-negative and false-positive rate per half-open bin of [low, high).

    Both rates are NULL in a bin with fewer than ``min_rows`` rows or without rows of the class.
    """
    inside = df.where((F.col(value) >= low) & (F.col(value) < high))
    spot = bin_index(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), bins)
    n = F.count(F.lit(1))
    enough = n >= F.lit(min_rows)
    miss = F.avg(F.when(F.col(truth) == 1, (F.col(predicted) == 0).cast("double")))
    alarm = F.avg(F.when(F.col(truth) == 0, (F.col(predicted) == 1).cast("double")))
    return inside.groupBy(*group, spot.alias("bin")).agg(
        n.alias("n"), F.when(enough, miss).alias("fn_rate"), F.when(enough, alarm).alias("fp_rate")
    )


def conditional_means(
    df: DataFrame, group: Sequence[str], label: str, value: str, digits: int = 3
) -> DataFrame:
    """Class counts, positive percentage and the value's mean inside each class."""
    y = F.col(label)
    return df.groupBy(*group).agg(
        F.count_if(y).alias("n_positive"),
        F.count_if(~y).alias("n_negative"),
        percent(F.count_if(y), F.count(F.lit(1)), digits).alias("pct_positive"),
        quantise(F.avg(F.when(y, F.col(value))), digits).alias("mean_positive"),
        quantise(F.avg(F.when(~y, F.col(value))), digits).alias("mean_negative"),
    )


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL-skipping means of several columns in one row."""
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """One row: class sizes, negatives per positive, and the balanced weight n / (2 * n_class)."""
    n, p = F.count(F.lit(1)), F.count_if(F.col(label) == 1)
    return df.agg(
        p.alias("n_positive"),
        (n - p).alias("n_negative"),
        F.try_divide((n - p).cast("double"), p).alias("pos_weight"),
        F.try_divide(n.cast("double"), F.lit(2.0) * p).alias("weight_positive"),
        F.try_divide(n.cast("double"), F.lit(2.0) * (n - p)).alias("weight_negative"),
    )


def misclassified(df: DataFrame, group: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """Wrong predictions per group, as count and percentage."""
    wrong = F.count_if(F.col(truth) != F.col(predicted))
    n = F.count(F.lit(1))
    return df.groupBy(*group).agg(
        n.alias("n_total"), wrong.alias("n_wrong"), percent(wrong, n).alias("pct_wrong")
    )


def type_profile(df: DataFrame) -> DataFrame:
    """Number of columns per data type, most frequent first."""
    listed = df.sparkSession.createDataFrame(df.dtypes, "column string, column_type string")
    return (
        listed.groupBy("column_type").agg(F.count(F.lit(1)).alias("n_columns"))
        .orderBy(F.desc("n_columns"), "column_type")
    )


def preview(df: DataFrame, columns: Sequence[str], n: int = 5, order: Sequence[Column] = ()) -> DataFrame:
    """The first n rows of a few columns, ordered if an order is given."""
    chosen = df.select(*columns)
    return (chosen.orderBy(*order) if order else chosen).limit(n)


def wide_to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per (key, feature) with the value as double."""
    cast = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(list(keys), list(columns), "feature", "value")


def pivot_metric(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """One row per ``row`` value with the listed columns in the given order."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.first(value, ignorenulls=True))


def metric_drop(df: DataFrame, model: str, split: str, metric: str, base: str, other: str) -> DataFrame:
    """Metric on two splits side by side, and the drop from the first to the second, largest first."""
    wide = pivot_metric(df.where(F.col(split).isin(base, other)), model, split, metric, [base, other])
    return (
        wide.where(F.col(base).isNotNull() & F.col(other).isNotNull())
        .withColumn("drop", F.col(base) - F.col(other))
        .orderBy(F.desc("drop"), model)
    )
