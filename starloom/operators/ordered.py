"""Order-dependent computations without a single-task sort.

A window over a whole group puts that group into one task. Here the rows are first summed by (group, value)
into a stored table, in one pass over the source; everything else reads that table. The ordered axis is cut into
value ranges (cut points come from one quantile pass over it, a bounded list), each range is handled by its own
window, and small per-range summaries carry the state from one range to the next.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.joins import materialise_small, null_safe_join
from starloom.session import stored_table

RANGE = "__range"


def usable(value: str) -> Column:
    """Rows with a real number: neither NULL nor NaN."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def range_count(df: DataFrame) -> int:
    """Ranges to cut: a few per shuffle partition, bounded so that the cut list stays tiny."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(4096, 2 * partitions))


def range_cuts(df: DataFrame, value: str, ranges: int | None = None) -> list[float]:
    """Increasing cut points that split the rows into ranges of about equal size.

    The cuts only balance the work, so they may be approximate: quantile sketches are merged per
    bundle of input partitions, in parallel, and the cuts are quantiles of the bundles' quantiles.
    No task merges more than its share of the sketches.
    """
    n = ranges or range_count(df)
    probs, accuracy = [i / n for i in range(1, n)], 4 * n
    bundles = min(200, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = F.col(value).cast("double").alias("__v")
    local = (
        df.select(number, F.pmod(F.spark_partition_id(), F.lit(bundles)).alias("__bundle"))
        .groupBy("__bundle")
        .agg(F.approx_percentile("__v", probs, accuracy).alias("__cuts"))
    )
    merged = local.select(F.explode("__cuts").alias("__v")).agg(
        F.approx_percentile("__v", probs, accuracy).alias("__cuts")
    )
    return sorted({c for c in (merged.first()["__cuts"] or []) if c is not None and math.isfinite(c)})


def with_range(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Add the range index of ``value``; a pure function of the value once the cuts are known."""
    edges = [float("-inf"), *(cuts or [0.0]), float("inf")]
    numeric = df.withColumn("__v", F.col(value).cast("double"))
    placed = Bucketizer(
        splits=edges, inputCol="__v", outputCol="__b", handleInvalid="keep"
    ).transform(numeric)
    return placed.withColumn(RANGE, F.col("__b").cast("int")).drop("__v", "__b")


def running_totals(
    df: DataFrame,
    value: str,
    weights: dict[str, Column],
    group: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """One row per (group, distinct value) with each weight's sum and its running total.

    ``weights`` maps a name to the summed expression; the output has ``name`` and ``cum_name``.
    The running total covers all values up to and including the row's, ascending or descending.
    Rows whose value is NULL or NaN are left out.
    """
    return totals_by_value(value_table(df, value, weights, group), value, list(weights), group, descending, ranges)


def value_table(df: DataFrame, value: str, weights: dict[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """Stored sums of the weights, one row per (group, distinct value) that is neither NULL nor NaN."""
    rows = df.where(usable(value)).select(*group, value, *[w.alias(k) for k, w in weights.items()])
    return stored_table(rows.groupBy(*group, value).agg(*[F.sum(k).alias(k) for k in weights]), "values")


def totals_by_value(
    table: DataFrame,
    value: str,
    weights: Sequence[str],
    group: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """``running_totals`` of a table that has one row per (group, value)."""
    group = list(group)
    per_value = with_range(table, value, range_cuts(table, value, ranges))
    per_range = per_value.groupBy(*group, RANGE).agg(*[F.sum(k).alias(f"__t_{k}") for k in weights])

    direction = F.col(RANGE).desc() if descending else F.col(RANGE).asc()
    before = Window.partitionBy(*group).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *group,
        RANGE,
        *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in weights],
    )
    offsets, _ = materialise_small(offsets)

    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (
        Window.partitionBy(*group, RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = null_safe_join(per_value, offsets, [*group, RANGE])
    return joined.select(
        *group,
        value,
        *weights,
        *[
            (F.sum(k).over(inside) + F.col(f"__o_{k}")).alias(f"cum_{k}")
            for k in weights
        ],
    )


def distribution_curve(
    df: DataFrame, value: str, group: Sequence[str] = (), fraction: str = "fraction"
) -> DataFrame:
    """Empirical distribution: per distinct value the share of rows at or below it."""
    group = list(group)
    table = value_table(df, value, {"n": F.lit(1).cast("bigint")}, group)
    counts = totals_by_value(table, value, ["n"], group)
    totals, _ = materialise_small(table.groupBy(*group).agg(F.sum("n").alias("__total")))
    if group:
        joined = null_safe_join(counts, totals, group)
        whole = F.col("__total")
    else:
        joined, whole = counts, totals.scalar()
    return joined.select(
        *group, value, "n", (F.col("cum_n") / whole.cast("double")).alias(fraction)
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, by rank, plus the row count ``n``.

    Only the value ranges that hold a wanted rank are sorted.
    """
    return quantiles_by_value(value_table(df, value, {"__c": F.lit(1).cast("bigint")}, group), value, probs, group)


def quantiles_by_value(
    table: DataFrame, value: str, probs: dict[str, float], group: Sequence[str] = (), count: str = "__c"
) -> DataFrame:
    """``exact_quantiles`` of a table that has one row per (group, value) and the number of rows with it."""
    group = list(group)
    keyed = with_range(table.select(*group, value, F.col(count).alias("__c")), value, range_cuts(table, value))
    per_range = keyed.groupBy(*group, RANGE).agg(F.sum("__c").alias("__t"))
    before = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    spans = per_range.select(
        *group,
        RANGE,
        "__t",
        F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"),
        F.sum("__t").over(whole).alias("__n"),
    )
    ranks = {}
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("__n") - F.lit(1)).cast("double")
        ranks[name] = (F.floor(at), F.ceil(at), at - F.floor(at).cast("double"))
    wanted = F.lit(False)
    for lo, hi, _ in ranks.values():
        for rank in (lo, hi):
            wanted = wanted | ((rank >= F.col("__o")) & (rank < F.col("__o") + F.col("__t")))
    # Few spans are broadcast and drop all other ranges before anything is shuffled.
    spans, _ = materialise_small(spans.where(wanted))
    per_value = null_safe_join(keyed, spans, [*group, RANGE]).drop("__t")
    inside = (
        Window.partitionBy(*group, RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = per_value.withColumn("__end", F.col("__o") + F.sum("__c").over(inside)).withColumn(
        "__start", F.col("__end") - F.col("__c")
    )
    out = []
    for name, (lo, hi, part) in ranks.items():
        low = F.max(F.when((lo >= F.col("__start")) & (lo < F.col("__end")), F.col(value)))
        high = F.max(F.when((hi >= F.col("__start")) & (hi < F.col("__end")), F.col(value)))
        out.append((low + F.max(part) * (high - low)).alias(name))
    return placed.groupBy(*group).agg(F.max("__n").alias("n"), *out)


def forward_fill(
    df: DataFrame,
    values: dict[str, Column],
    is_source: Column,
    group: Sequence[str],
    order: Sequence[str],
    block: Sequence[str],
) -> DataFrame:
    """Give every row the values of the latest source row at or before it in its group.

    ``block`` columns cut a group into ordered pieces (file split, turn range) so that a long group
    is never sorted in one task: each piece is filled on its own, and the last source row of every
    piece is carried over to the following ones through a small per-piece table.
    """
    group, order, block = list(group), list(order), list(block)
    packed = F.when(is_source, F.struct(*[v.alias(k) for k, v in values.items()]))
    marked = df.withColumn("__src", packed)
    inside = (
        Window.partitionBy(*group, *block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    source_order = F.when(F.col("__src").isNotNull(), F.struct(*order))
    last_in_block = marked.groupBy(*group, *block).agg(F.max_by("__src", source_order).alias("__last"))
    before = Window.partitionBy(*group).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    carried = last_in_block.select(
        *group, *block, F.last("__last", ignorenulls=True).over(before).alias("__carry")
    )
    carried, _ = materialise_small(carried)
    filled = null_safe_join(marked, carried, [*group, *block], "left").withColumn(
        "__fill",
        F.coalesce(F.last("__src", ignorenulls=True).over(inside), F.col("__carry")),
    )
    kept = [c for c in df.columns if c not in values]
    return filled.select(*kept, *[F.col(f"__fill.{k}").alias(k) for k in values])


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add the place of each row in a total order, from 1, without a single-task sort.

    The sorted rows are stored with their place within their piece of the order; the pieces, one row each,
    give the offsets. ``order`` must not leave ties.
    """
    local, piece = "__local", "__piece"
    rows = stored_table(df.orderBy(*order).withColumn(local, F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn(piece, F.shiftright(local, 33))
    sizes = rows.groupBy(piece).agg(F.count(F.lit(1)).alias("__t"))
    before = Window.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(piece, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    place = F.col(local).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__o") + F.lit(1)
    return rows.join(offsets, piece).select(*df.columns, place.alias(name))
