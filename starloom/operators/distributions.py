"""The tables behind distribution plots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions import bin_index
from starloom.operators.joins import materialise_small, null_safe_join
from starloom.operators.ordered import quantiles_by_value, usable, value_table
from starloom.operators.profile import wide_to_long


def closed_bin(value: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """0-based bin of [low, high] with the last bin closed; NULL outside."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    v, lo, hi = value.cast("double"), lo.cast("double"), hi.cast("double")
    return F.when((v >= lo) & (v <= hi), F.least(bin_index(v, lo, hi, bins), F.lit(bins - 1)))


def histogram(
    df: DataFrame,
    value: str,
    bins: int,
    low: float | None = None,
    high: float | None = None,
    group: Sequence[str] = (),
    density: bool = False,
) -> DataFrame:
    """Counts per equal-width bin and group; without edges the data's own range is used.

    With ``density`` the count divided by (rows in range of the group * bin width) is added.
    Empty bins have no row.
    """
    group = list(group)
    clean = df.where(usable(value))
    lo = clean.agg(F.min(value)).scalar() if low is None else F.lit(float(low))
    hi = clean.agg(F.max(value)).scalar() if high is None else F.lit(float(high))
    if low is None and high is None:  # a column of one value lies in the middle of a range of one
        flat = F.when(lo == hi, F.lit(0.5)).otherwise(F.lit(0.0))
        lo, hi = lo - flat, hi + flat
    counts = (
        clean.select(*group, closed_bin(F.col(value), lo, hi, bins).alias("bin"))
        .where(F.col("bin").isNotNull())
        .groupBy(*group, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not density:
        return counts
    # At most ``bins`` rows per group reach this window.
    per_group = F.sum("n").over(Window.partitionBy(*(group or [F.lit(1)])))
    return counts.withColumn("density", F.col("n") / (per_group * ((hi - lo) / F.lit(float(bins)))))


def class_mean_lines(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Reference lines of a histogram: the value's mean per class."""
    return df.where(usable(value)).groupBy(*group).agg(F.avg(value).alias("mean"))


def box_plot(df: DataFrame, columns: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per feature and group."""
    keys = [*group, "feature"]
    tall = value_table(wide_to_long(df, group, columns), "value", {"__c": F.lit(1).cast("bigint")}, keys)
    quart = quantiles_by_value(tall, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    fences = quart.withColumns({
        "__lo": F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1")),
        "__hi": F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1")),
    })
    fences, _ = materialise_small(fences)
    joined = null_safe_join(tall, fences, keys)
    inside = (F.col("value") >= F.col("__lo")) & (F.col("value") <= F.col("__hi"))
    # A whisker never ends inside the box: with no data point between fence and box it is the box edge.
    low = F.least(F.min(F.when(inside, F.col("value"))), F.max("q1"))
    high = F.greatest(F.max(F.when(inside, F.col("value"))), F.max("q3"))
    return joined.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        low.alias("whisker_low"),
        high.alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("__c"))), F.lit(0)).alias("n_outliers"),
    )


# Groups whose kernel sums a task holds before it hands them on.
VIOLIN_GROUPS_HELD = 4096


def violin(
    df: DataFrame, value: str, group: Sequence[str], points: int = 100, bandwidth: float | None = None
) -> DataFrame:
    """Gaussian kernel density of each group on an even grid between its minimum and maximum, and its median.

    Groups of one row or one value have no density: one row at point 0 with a NULL density.

    ``bandwidth`` is the factor on the sample standard deviation; by default n ** (-1/5). Every task
    adds up the kernel sums of its own (value, count) pairs on the grid, so repeated values cost nothing, a
    group of any size leaves a task as ``points`` rows and no (row, grid point) pairs are shuffled.
    """
    group = list(group)
    real = df.where(usable(value)).select(*group, F.col(value).cast("double").alias("__v"))
    clean = value_table(real, "__v", {"__c": F.lit(1).cast("bigint")}, group)
    n, total = F.sum("__c").cast("double"), F.sum(F.col("__v") * F.col("__c"))
    centres, _ = materialise_small(clean.groupBy(*group).agg((total / n).alias("__mean")))
    centred = null_safe_join(clean, centres, group) if group else clean.withColumn("__mean", centres.scalar())
    factor = F.lit(float(bandwidth)) if bandwidth is not None else F.pow(n, F.lit(-0.2))
    apart = F.col("__v") - F.col("__mean")
    spread = F.sqrt(F.try_divide(F.sum(F.col("__c") * apart * apart), n - F.lit(1.0)))
    stats = centred.groupBy(*group).agg(
        n.alias("__n"),
        F.min("__v").alias("__lo"),
        F.max("__v").alias("__hi"),
        F.when(F.min("__v") < F.max("__v"), factor * spread).alias("__bw"),
    )
    single = stats.where(~F.coalesce(F.col("__bw") > 0, F.lit(False)) & (F.col("__n") > 0))
    single = single.select(*group, F.lit(0).alias("point"), F.col("__lo").alias("x"), F.lit(None).cast("double").alias("density"))
    stats, _ = materialise_small(stats.where(F.col("__bw") > 0))
    if group:
        rows = null_safe_join(clean, stats, group)
    else:
        rows = clean.withColumns({c: stats.select(c).scalar() for c in ("__n", "__lo", "__hi", "__bw")})
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    out_schema = ", ".join(
        [f"`{g}` {fields[g]}" for g in group]
        + ["__n double", "__lo double", "__hi double", "__bw double", "point int", "__sum double"]
    )

    keys = [*group, "__n", "__lo", "__hi", "__bw"]

    def flush(totals: dict) -> Iterator[pd.DataFrame]:
        for key, total in totals.items():
            frame = pd.DataFrame({"point": np.arange(points, dtype="int32"), "__sum": total})
            for name, item in zip(keys, key, strict=True):
                item = None if pd.isna(item) else item
                frame[name] = pd.Series([item] * points, dtype=object) if name in group else item
            yield frame[[*keys, "point", "__sum"]]

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {}
        for batch in batches:
            for key, part in batch.groupby(keys, dropna=False, sort=False):
                grid, bw = np.linspace(key[-3], key[-2], points), key[-1]
                total = totals.setdefault(key, np.zeros(points))
                pieces = max(1, len(part) // 4096)
                for v, c in zip(*(np.array_split(part[k].to_numpy(), pieces) for k in ("__v", "__c")), strict=True):
                    z = (grid[:, None] - v[None, :]) / bw
                    total += np.exp(-0.5 * z * z) @ c
            if len(totals) > VIOLIN_GROUPS_HELD:
                yield from flush(totals)
                totals = {}
        yield from flush(totals)

    sums = rows.select(*group, "__n", "__lo", "__hi", "__bw", "__v", "__c").mapInPandas(partial_sums, out_schema)
    x = F.max("__lo") + F.col("point") * (F.max("__hi") - F.max("__lo")) / F.lit(float(points - 1))
    norm = F.max("__n") * F.max("__bw") * F.lit(float(np.sqrt(2.0 * np.pi)))
    curve = sums.groupBy(*group, "point").agg(x.alias("x"), (F.sum("__sum") / norm).alias("density"))
    median = quantiles_by_value(clean.withColumnRenamed("__v", "__x"), "__x", {"median": 0.5}, group)
    median = median.select(*group, "median")
    curve = curve.unionByName(single)
    return null_safe_join(curve, median, group) if group else curve.crossJoin(median)


# Smoothing of the 2-D histogram.
GRID_BINS = 80
SMOOTH_SIGMA = 1.5
KERNEL_TRUNCATE = 4.0


def gaussian_taps(sigma: float) -> list[tuple[int, float]]:
    """Normalised 1-D Gaussian weights at whole-cell offsets up to 4 sigma."""
    radius = int(KERNEL_TRUNCATE * sigma + 0.5)
    raw = [float(np.exp(-0.5 * (k / sigma) ** 2)) for k in range(-radius, radius + 1)]
    return [(k, w / sum(raw)) for k, w in zip(range(-radius, radius + 1), raw, strict=True)]


def _smooth_axis(cells: DataFrame, axis: str, others: Sequence[str], bins: int, sigma: float) -> DataFrame:
    """Spread every occupied cell along one axis. Output cell i takes weight k from the mirrored
    input cell i + k, so an input cell j feeds every i whose mirrored i + k equals j."""
    radius = int(KERNEL_TRUNCATE * sigma + 0.5)
    if radius > bins:
        raise ValueError(f"smoothing reaches {radius} cells, more than the {bins} bins of the grid")
    images = F.array(
        F.col(axis),
        F.lit(-1) - F.col(axis),
        F.lit(2 * bins - 1) - F.col(axis),
    )
    taps = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in gaussian_taps(sigma)
    ])
    spread = (
        cells.select(*others, F.explode(images).alias("__image"), "v")
        .where((F.col("__image") >= -radius) & (F.col("__image") < bins + radius))
        .select(*others, "__image", "v", F.inline(taps))
        .withColumn(axis, F.col("__image") - F.col("k"))
        .where(F.col(axis).between(0, bins - 1))
    )
    return spread.groupBy(*others, axis).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def data_limits(df: DataFrame, x: str, y: str) -> tuple[float, float, float, float]:
    """Common axis limits of a 2-D histogram: four numbers from one aggregate; zeros without usable rows."""
    row = df.where(usable(x) & usable(y)).agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return tuple(0.0 if v is None else float(v) for v in row)


def density_grid(
    df: DataFrame,
    x: str,
    y: str,
    group: Sequence[str] = (),
    limits: tuple[float, float, float, float] | None = None,
    bins: int = GRID_BINS,
    sigma: float = SMOOTH_SIGMA,
) -> DataFrame:
    """Smoothed 2-D histogram per group: (group, bx, by, v). Cells the kernel does not reach have no
    row; their value is zero."""
    group = list(group)
    x0, x1, y0, y1 = limits or data_limits(df, x, y)
    counts = (
        df.where(usable(x) & usable(y))
        .select(
            *group,
            closed_bin(F.col(x), x0, x1, bins).alias("bx"),
            closed_bin(F.col(y), y0, y1, bins).alias("by"),
        )
        .where(F.col("bx").isNotNull() & F.col("by").isNotNull())
        .groupBy(*group, "bx", "by")
        .agg(F.count(F.lit(1)).cast("double").alias("v"))
    )
    once = _smooth_axis(counts, "bx", [*group, "by"], bins, sigma)
    return _smooth_axis(once, "by", [*group, "bx"], bins, sigma).select(*group, "bx", "by", "v")


def containment_levels(
    grid: DataFrame, shares: dict[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Per group the cell value at which the running sum of descending cells reaches each share.

    A group has at most bins * bins cells, so a window per group is bounded.
    """
    part = Window.partitionBy(*(list(group) or [F.lit(1)]))
    desc = part.orderBy(F.col("v").desc(), "bx", "by").rowsBetween(Window.unboundedPreceding, 0)
    ranked = grid.withColumns({"__cum": F.sum("v").over(desc), "__all": F.sum("v").over(part)})
    return ranked.groupBy(*group).agg(
        *[
            F.max(F.when(F.col("__cum") >= F.lit(q) * F.col("__all"), F.col("v"))).alias(name)
            for name, q in shares.items()
        ]
    )


def outside_contour(
    df: DataFrame,
    x: str,
    y: str,
    share: float = 0.95,
    group: Sequence[str] = (),
    limits: tuple[float, float, float, float] | None = None,
    bins: int = GRID_BINS,
    sigma: float = SMOOTH_SIGMA,
    flag: str = "is_outlier",
) -> DataFrame:
    """Flag the rows that lie in a cell below the group's containment level."""
    group = list(group)
    x0, x1, y0, y1 = limits or data_limits(df, x, y)
    grid = density_grid(df, x, y, group, (x0, x1, y0, y1), bins, sigma)
    levels = containment_levels(grid, {"__level": share}, group)
    if group:
        marked = null_safe_join(grid, levels, group)
    else:
        marked = grid.withColumn("__level", levels.scalar())
    cells, _ = materialise_small(marked.select(*group, "bx", "by", (F.col("v") < F.col("__level")).alias(flag)))

    def clipped(value: str, lo: float, hi: float) -> Column:
        spot = bin_index(F.col(value).cast("double"), F.lit(lo), F.lit(hi), bins)
        return F.greatest(F.lit(0), F.least(spot, F.lit(bins - 1)))

    rows = df.where(usable(x) & usable(y)).withColumns(
        {"bx": clipped(x, x0, x1), "by": clipped(y, y0, y1)}
    )
    joined = null_safe_join(rows, cells, [*group, "bx", "by"], "left")
    return joined.select(*df.columns, F.coalesce(F.col(flag), F.lit(True)).alias(flag))
