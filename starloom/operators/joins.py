"""Small-side handling shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL_SIDE_ROWS = 100_000


def materialise_small(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate an aggregate once when it is proven to be small.

    At most ``max_rows + 1`` rows are fetched. If the frame is within the bound it comes back as
    literal rows whose size the planner knows, together with True; otherwise the lazy frame is
    returned unchanged with False and joins on it stay shuffled.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where NULL matches NULL; the key columns of the left side are kept."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = part if cond is None else cond & part
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])
