"""Exact seeded sampling and splitting.

Membership is decided by the order of a seeded hash of the row key, so it does not depend on
partitioning. The rows are stored once with their hash; the wanted rank of a stratum is turned into a
hash threshold by refinement: an aggregate counts rows per (stratum, hash prefix), the prefix that holds
the rank is counted again by a longer prefix until few rows share it, and only those are ordered. Every
row is then placed by comparing its own hash with the threshold. No stratum is ever sorted in one task,
and strata, their quotas and thresholds are tables of any size. Keys must be unique, as in any table that
is split by key: copies of a key that a threshold would have to part raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions import stable_hash
from starloom.operators.joins import materialise_small, null_safe_join
from starloom.operators.ordered import numbered
from starloom.session import stored_table

HASH = "__hash"
HASH_BYTES, STEP_BYTES = 16, 2
BUCKET_ROWS = 100_000


def largest_remainder(classes: DataFrame, label: str, size: str, wanted: int, total: int, name: str) -> DataFrame:
    """Add ``name``: ``wanted`` divided over the classes in proportion to ``size``, whose sum is ``total``.

    Whole parts first; the rest goes to the largest remainders, ties to the class value that comes first as
    text, NULL before all. Products are exact decimals.
    """
    product = f"cast({wanted} as decimal(19,0)) * cast(`{size}` as decimal(19,0))"
    shares = classes.withColumns({
        "__share": F.expr(f"({product}) div {max(total, 1)}"),
        "__rest": F.expr(f"cast(({product}) % {max(total, 1)} as bigint)"),
    })
    rest = wanted - (shares.agg(F.sum("__share")).first()[0] or 0)
    if rest:
        placed = numbered(shares, [F.col("__rest").desc(), F.col(label).cast("string").asc_nulls_first()], "__place")
        share = F.col("__share") + (F.col("__place") <= rest).cast("bigint")
    else:
        placed, share = shares, F.col("__share")
    return placed.select(*classes.columns, share.alias(name))


def _prefix(length: int) -> Column:
    return F.substring(HASH, 1, length)


@dataclass
class HashedClasses:
    """Stored rows with their hash, and the table of classes: their value and row count ``__n``."""

    rows: DataFrame
    label: str
    classes: DataFrame
    total: int

    @classmethod
    def of(cls, df: DataFrame, label: str, key: Sequence[str], seed: int | str) -> HashedClasses:
        rows = stored_table(df.withColumn(HASH, F.unhex(stable_hash(seed, *key))), "hashed")
        counted = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
        classes, small = materialise_small(counted)
        classes = classes if small else stored_table(classes, "classes")
        return cls(rows, label, classes, classes.agg(F.sum("__n")).first()[0] or 0)

    def thresholds(self, ranks: DataFrame, names: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
        """Per class and rank name, the hash of the row with that rank (1-based; NULL for rank 0).

        ``ranks`` has one row per class and one column per name.
        """
        label = self.label
        each = F.array(*[F.struct(F.lit(n).alias("__name"), F.col(n).alias("__rank")) for n in names])
        pending = ranks.select(label, F.inline(each)).where(F.col("__rank") > 0)
        pending = pending.withColumn("__prefix", F.lit(b""))
        found: list[DataFrame] = []
        for length in range(STEP_BYTES, HASH_BYTES + 1, STEP_BYTES):
            above = length - STEP_BYTES
            inside = self.rows.select(label, HASH)
            if above:
                held = pending.select(label, "__prefix").distinct()
                inside = null_safe_join(inside.withColumn("__prefix", _prefix(above)), held, [label, "__prefix"])
            spans = inside.groupBy(label, _prefix(length).alias("__next")).agg(F.count(F.lit(1)).alias("__t"))
            spans = spans.withColumn("__prefix", F.substring("__next", 1, above))
            order = Window.partitionBy(label, "__prefix").orderBy("__next")
            before = order.rowsBetween(Window.unboundedPreceding, -1)
            spans = spans.withColumn("__o", F.coalesce(F.sum("__t").over(before), F.lit(0)))
            edges = null_safe_join(spans, pending, [label, "__prefix"]).where(
                (F.col("__rank") > F.col("__o")) & (F.col("__rank") <= F.col("__o") + F.col("__t"))
            )
            edges = edges.select(
                label, "__name", (F.col("__rank") - F.col("__o")).alias("__rank"), F.col("__next").alias("__prefix"), "__t"
            )
            edges, small = materialise_small(edges)
            edges = edges if small else stored_table(edges, "edges")
            settled = (F.col("__t") <= bucket_rows) | F.lit(length == HASH_BYTES)
            found.append(self._hash_at(edges.where(settled).drop("__t"), length))
            pending = edges.where(~settled).drop("__t")
            if pending.isEmpty():
                break
        limits = reduce(DataFrame.unionByName, found).groupBy(label).agg(
            *[F.max(F.when(F.col("__name") == n, F.col(HASH))).alias(n) for n in names]
        )
        limits, small = materialise_small(limits)
        return limits if small else stored_table(limits, "limits")

    def _hash_at(self, edges: DataFrame, length: int) -> DataFrame:
        """The hash at each wanted rank among the rows that share its prefix."""
        near = self.rows.select(self.label, HASH, _prefix(length).alias("__prefix"))
        near = null_safe_join(near, edges, [self.label, "__prefix"])
        order = Window.partitionBy(self.label, "__name").orderBy(HASH)
        placed = near.withColumns({"__at": F.row_number().over(order), "__after": F.lead(HASH).over(order)})
        message = "rows of one key lie on both sides of a split: the key is not unique"
        whole = F.when(F.col("__after") == F.col(HASH), F.raise_error(F.lit(message)).cast("binary")).otherwise(F.col(HASH))
        return placed.where(F.col("__at") == F.col("__rank")).select(self.label, "__name", whole.alias(HASH))

    def assign(self, ranks: DataFrame, names: Sequence[str], other: str, name: str = "split_role") -> DataFrame:
        """Add a role column: the first rank name whose threshold is not below the row's hash.

        ``ranks`` gives cumulative class ranks in increasing order, e.g. test first, then test + val.
        """
        limits = self.thresholds(ranks, names).withColumnsRenamed({n: f"__lim_{n}" for n in names})
        placed = null_safe_join(self.rows, limits, [self.label], "left")
        role: Column | None = None
        for n in names:
            hit = F.col(HASH) <= F.col(f"__lim_{n}")
            role = F.when(hit, n) if role is None else role.when(hit, n)
        kept = [c for c in self.rows.columns if c != HASH]
        return placed.select(*kept, role.otherwise(F.lit(other)).alias(name))


def stratified_three_way(
    df: DataFrame, label: str, key: Sequence[str], seed: int, train_fraction: float, val_fraction: float
) -> DataFrame:
    """Exact stratified train / val / test roles.

    Test takes ceil((1 - train - val) * n) rows, val takes ceil of its share of the remainder, train
    takes the rest; each is divided over the classes by largest remainder.
    """
    hashed = HashedClasses.of(df, label, key, seed)
    test = math.ceil((1.0 - train_fraction - val_fraction) * hashed.total)
    left = hashed.total - test
    val = math.ceil(val_fraction / (train_fraction + val_fraction) * left)
    ranks = largest_remainder(hashed.classes, label, "__n", test, hashed.total, "test")
    ranks = ranks.withColumn("__left", F.col("__n") - F.col("test"))
    ranks = largest_remainder(ranks, label, "__left", val, left, "val")
    return hashed.assign(ranks.withColumn("val", F.col("test") + F.col("val")), ["test", "val"], "train")


def stratified_two_way(
    df: DataFrame, label: str, key: Sequence[str], seed: int, val_fraction: float
) -> DataFrame:
    """Exact stratified train / val roles; val takes ceil(val_fraction * n) rows."""
    hashed = HashedClasses.of(df, label, key, seed)
    val = math.ceil(val_fraction * hashed.total)
    return hashed.assign(largest_remainder(hashed.classes, label, "__n", val, hashed.total, "val"), ["val"], "train")


def cross_population_split(
    df: DataFrame,
    population: str,
    train: Sequence[str],
    test: Sequence[str],
    label: str,
    key: Sequence[str],
    seed: int,
    val_fraction: float,
) -> DataFrame:
    """Train and val from the train populations, every row of the test populations as test."""
    overlap = set(train) & set(test)
    if overlap:
        raise ValueError(f"populations in both train and test give a row two roles: {sorted(overlap)}")
    inside = stratified_two_way(df.where(F.col(population).isin(list(train))), label, key, seed, val_fraction)
    outside = df.where(F.col(population).isin(list(test))).withColumn("split_role", F.lit("test"))
    return inside.unionByName(outside)


def stratified_sample(df: DataFrame, label: str, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """At most about n rows with the class shares kept: round(share * n) per class, half to even."""
    hashed = HashedClasses.of(df, label, key, seed)
    if hashed.total <= n:
        return df
    share = F.rint(F.col("__n") / F.lit(float(hashed.total)) * F.lit(float(n))).cast("bigint")
    quota = hashed.classes.withColumn("in", F.least(share, F.col("__n")))
    return hashed.assign(quota, ["in"], "out", name="__role").where(F.col("__role") == "in").drop("__role")


def fixed_size_sample(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows, taken after all filters, as a distributed top-n by hash."""
    return df.withColumn(HASH, stable_hash(seed, *key)).orderBy(HASH).limit(n).drop(HASH)
