"""Nearest neighbour and neighbour counts in periodic boxes, as equi-joins on grid cells.

Both start from the distinct positions of a group (copies of one position become one row with a
multiplicity), so coincident objects cost nothing. Dense regions are handled by refining the grid
where the objects are, never by testing all pairs of a crowded cell:

* The radius count works on pairs of cells. A pair that lies wholly inside the radius adds the whole
  cell count, a pair wholly outside is dropped, a small pair is tested position by position, and only
  a crowded pair cut by the radius is split into its sub-cells, level by level.
* The nearest neighbour starts each position at a level where its own cell is not crowded and looks at
  the surrounding cells. A distance within one cell width is final. The few positions left go down a pyramid
  of occupied cells from the coarsest level: an occupied cell bounds the distance from above, and cells that
  are farther than the best bound are dropped before they are opened. Only the cells left at the bottom are
  tested position by position, so a far position beside a dense cluster meets a few of its members.

Both are exact; the bounds only decide which way the exact answer is found. Cell arithmetic carries a
relative margin of 1e-9 so that rounding cannot move a pair out of reach.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.joins import materialise_small
from starloom.session import ensure_checkpoint_dir, stored_table

MARGIN = 1e-9
MAX_LEVEL = 20
CROWDED_CELL = 64
CROWDED_PAIR = 16_384


class _Grid:
    """Column expressions over the position columns p0.. and cells of n per axis."""

    def __init__(self, dims: int) -> None:
        self.dims = dims
        self.pos = [f"p{i}" for i in range(dims)]
        self.cell = [f"c{i}" for i in range(dims)]

    def cells(self, n: Column) -> dict[str, Column]:
        """Cell index per axis; doubling n halves the cells exactly, so levels are nested."""
        out = {}
        for p, c in zip(self.pos, self.cell, strict=True):
            spot = F.floor(F.col(p) / F.col("box") * n).cast("bigint")
            out[c] = F.least(spot, n.cast("bigint") - F.lit(1))
        return out

    def spread(self, df: DataFrame, n: Column, keep: Sequence[Column | str]) -> DataFrame:
        """One row per distinct wrapped cell within one step on every axis, keeping ``keep``."""
        whole = n.cast("bigint")
        out = df.select(*keep, whole.alias("__n"), *self.cell)
        for c in self.cell:
            steps = F.array(*[F.pmod(F.col(c) + F.lit(o), F.col("__n")) for o in (-1, 0, 1)])
            out = out.withColumn(c, F.explode(F.array_distinct(steps)))
        return out.drop("__n")

    def distance2(self, other: Sequence[str]) -> Column:
        parts = []
        for p, o in zip(self.pos, other, strict=True):
            gap = F.abs(F.col(p) - F.col(o))
            gap = F.least(gap, F.col("box") - gap)
            parts.append(gap * gap)
        return reduce(lambda a, b: a + b, parts)

    def differs(self, other: Sequence[str]) -> Column:
        return reduce(
            lambda a, b: a | b,
            [F.col(p) != F.col(o) for p, o in zip(self.pos, other, strict=True)],
        )


def _group_key(group: str) -> Column:
    """The group as a value that joins where it is NULL: a struct is never NULL itself."""
    return F.struct(F.col(group).alias("v")).alias("g")


def distinct_places(df: DataFrame, group: str, coords: Sequence[str], box: str) -> DataFrame:
    """Distinct positions per group with their multiplicity; positions outside [0, box) raise."""
    columns = []
    for i, c in enumerate(coords):
        v = F.col(c).cast("double") + F.lit(0.0)
        bad = F.concat(F.lit(f"{c} outside [0, box): "), F.coalesce(v.cast("string"), F.lit("NULL")))
        inside = (v >= 0) & (v < F.col(box).cast("double"))
        columns.append(F.when(inside, v).otherwise(F.raise_error(bad).cast("double")).alias(f"p{i}"))
    pos = [f"p{i}" for i in range(len(coords))]
    return (
        df.select(_group_key(group), F.col(box).cast("double").alias("box"), *columns)
        .groupBy("g", "box", *pos)
        .agg(F.count(F.lit(1)).alias("m"))
    )


def _radius_counts(places: DataFrame, dims: int, radius: float, crowded_pair: int) -> DataFrame:
    """(g, position) -> number of objects within the radius, the object itself included."""
    grid = _Grid(dims)
    pos, cell = grid.pos, grid.cell
    r2 = radius * radius
    base = F.greatest(
        F.lit(1.0), F.floor(F.col("box") / F.lit(radius * (1 + MARGIN))).cast("double")
    )
    place = ["g", "box", *pos]
    b_pos = [f"q{i}" for i in range(dims)]

    def at_level(level: int) -> tuple[DataFrame, Column]:
        n = base * F.lit(float(2**level))
        return places.withColumns(grid.cells(n)), n

    placed, n = at_level(0)
    crowd = placed.groupBy("g", *cell).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    if crowd * crowd <= crowded_pair:
        queries = grid.spread(placed, n, place)
        others = placed.select("g", *cell, *[F.col(p).alias(q) for p, q in zip(pos, b_pos, strict=True)], "m")
        return (
            queries.join(others, ["g", *cell])
            .where(grid.distance2(b_pos) <= r2)
            .groupBy("g", *pos)
            .agg(F.sum("m").alias("n_within"))
        )

    parts: list[DataFrame] = []
    a, b = [f"a{i}" for i in range(dims)], [f"b{i}" for i in range(dims)]

    def cell_table(placed: DataFrame) -> DataFrame:
        return placed.groupBy("g", "box", *cell).agg(
            F.count(F.lit(1)).alias("k"), F.sum("m").alias("w")
        )

    cells = cell_table(placed)
    own = [F.col(c).alias(x) for c, x in zip(cell, a, strict=True)]
    left = grid.spread(cells, n, ["g", "box", F.col("k").alias("ka"), *own])
    right = cells.select("g", *cell, F.col("k").alias("kb"), F.col("w").alias("wb"))
    pairs = left.join(right, ["g", *cell]).withColumnsRenamed(dict(zip(cell, b, strict=True)))

    for level in range(MAX_LEVEL + 1):
        placed, n = at_level(level)
        width = F.col("box") / n
        near, far = [], []
        for x, y in zip(a, b, strict=True):
            step = F.abs(F.col(x) - F.col(y)).cast("double")
            step = F.least(step, n - step)
            near.append(F.pow(F.greatest(step - 1.0, F.lit(0.0)) * width, F.lit(2.0)))
            far.append(F.pow(F.least((step + 1.0) * width, F.col("box") / 2.0), F.lit(2.0)))
        nearest, farthest = (reduce(lambda u, v: u + v, s) for s in (near, far))
        state = (
            F.when(farthest <= r2 * (1 - MARGIN), F.lit("inside"))
            .when(nearest > r2 * (1 + MARGIN), F.lit("outside"))
            .when(
                (F.col("ka") * F.col("kb") <= F.lit(crowded_pair)) | F.lit(level == MAX_LEVEL),
                F.lit("test"),
            )
            .otherwise(F.lit("split"))
        )
        pairs = pairs.withColumn("state", state).where(F.col("state") != "outside").checkpoint()

        whole = pairs.where(F.col("state") == "inside").groupBy("g", *a).agg(F.sum("wb").alias("n_part"))
        keyed = placed.withColumnsRenamed(dict(zip(cell, a, strict=True)))
        parts.append(keyed.join(whole, ["g", *a]).select("g", *pos, "n_part"))

        tested = pairs.where(F.col("state") == "test").select("g", *a, *b)
        others = placed.select(
            "g",
            *[F.col(c).alias(y) for c, y in zip(cell, b, strict=True)],
            *[F.col(p).alias(q) for p, q in zip(pos, b_pos, strict=True)],
            F.col("m").alias("mb"),
        )
        parts.append(
            keyed.select(*place, *a)
            .join(tested, ["g", *a])
            .join(others, ["g", *b])
            .where(grid.distance2(b_pos) <= r2)
            .groupBy("g", *pos)
            .agg(F.sum("mb").alias("n_part"))
        )

        split = pairs.where(F.col("state") == "split").select("g", *a, *b)
        if split.isEmpty():
            break
        finer, _ = at_level(level + 1)
        crowded = split.select("g", *[F.col(x).alias(f"u{i}") for i, x in enumerate(a)]).distinct()
        up = {f"u{i}": F.shiftright(F.col(c), 1) for i, c in enumerate(cell)}
        children = (
            finer.withColumns(up)
            .join(crowded, ["g", *up], "left_semi")
            .groupBy("g", "box", *up, *cell)
            .agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("w"))
            .checkpoint()
        )
        side_a = children.select(
            "g", "box", F.col("k").alias("ka"),
            *[F.col(u).alias(x) for u, x in zip(up, a, strict=True)],
            *[F.col(c).alias(f"n{x}") for c, x in zip(cell, a, strict=True)],
        )
        side_b = children.select(
            "g", F.col("k").alias("kb"), F.col("w").alias("wb"),
            *[F.col(u).alias(y) for u, y in zip(up, b, strict=True)],
            *[F.col(c).alias(f"n{y}") for c, y in zip(cell, b, strict=True)],
        )
        pairs = (
            split.join(side_a, ["g", *a])
            .join(side_b, ["g", *b])
            .select(
                "g", "box", "ka", "kb", "wb",
                *[F.col(f"n{x}").alias(x) for x in a],
                *[F.col(f"n{y}").alias(y) for y in b],
            )
        )
    return reduce(DataFrame.unionByName, parts).groupBy("g", *pos).agg(F.sum("n_part").alias("n_within"))


def _start_levels(places: DataFrame, dims: int, crowded_cell: int) -> DataFrame:
    """Add ``lvl``: 2**lvl cells per axis, about one place per cell, finer where a cell is crowded."""
    grid = _Grid(dims)
    sizes = places.groupBy("g").agg(
        F.greatest(
            F.lit(1), F.least(F.floor(F.log2(F.count(F.lit(1)).cast("double")) / F.lit(dims)), F.lit(MAX_LEVEL))
        ).cast("int").alias("lvl")
    )
    sizes, _ = materialise_small(sizes)
    active = places.join(sizes, "g")
    settled: list[DataFrame] = []
    while True:
        celled = active.withColumns(grid.cells(F.pow(F.lit(2.0), F.col("lvl"))))
        crowded = (
            celled.where(F.col("lvl") < MAX_LEVEL)
            .groupBy("g", "lvl", *grid.cell)
            .agg(F.count(F.lit(1)).alias("k"))
            .where(F.col("k") > crowded_cell)
            .checkpoint()
        )
        if crowded.isEmpty():
            break
        keys = ["g", "lvl", *grid.cell]
        marked = celled.join(crowded, keys, "left")
        settled.append(marked.where(F.col("k").isNull()).select(*active.columns))
        active = (
            marked.where(F.col("k").isNotNull())
            .withColumn("lvl", F.col("lvl") + 1)
            .select(*active.columns)
            .checkpoint()
        )
    return reduce(DataFrame.unionByName, [*settled, active])


def _pyramid(leaves: DataFrame, dims: int) -> DataFrame:
    """Occupied cells of every level from 1 to the leaves: places in them, and whether they are a leaf."""
    cell = _Grid(dims).cell
    cells = leaves.groupBy("g", "lvl", *cell).agg(F.count(F.lit(1)).alias("k"))
    each = cells.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("lvl"))))
    up = [F.expr(f"shiftright({c}, lvl - at)").alias(c) for c in cell]
    each = each.select("g", F.col("at").alias("lvl"), *up, "k", (F.col("at") == F.col("lvl")).alias("leaf"))
    return stored_table(
        each.groupBy("g", "lvl", *cell).agg(F.sum("k").alias("k"), F.bool_or("leaf").alias("leaf")), "pyramid"
    )


def _leaves_in_reach(pending: DataFrame, pyramid: DataFrame, dims: int) -> DataFrame:
    """(position, leaf) for every leaf that can hold the nearest other place of a position."""
    grid = _Grid(dims)
    pos, cell = grid.pos, grid.cell
    n = F.pow(F.lit(2.0), F.col("lvl"))
    width = F.col("box") / n
    near, far = [], []
    for p, c in zip(pos, cell, strict=True):
        gap = F.abs(F.col(p) - (F.col(c) + F.lit(0.5)) * width)
        gap = F.least(gap, F.col("box") - gap)
        near.append(F.pow(F.greatest(gap - width / 2, F.lit(0.0)), F.lit(2.0)))
        far.append(F.pow(F.least(gap + width / 2, F.col("box") / 2), F.lit(2.0)))
    nearest, farthest = (reduce(lambda u, v: u + v, s) for s in (near, far))
    own = reduce(lambda u, v: u & v, [spot == F.col(c) for c, spot in grid.cells(n).items()])
    of_place = Window.partitionBy("g", *pos)
    top, _ = materialise_small(pyramid.where(F.col("lvl") == 1))
    nodes = pending.select("g", "box", *pos).join(top, "g")
    level = 1
    while True:
        # the cell of the position itself counts only if it holds another place
        occupied = nodes.where(F.col("k") > F.when(own, 1).otherwise(0)).withColumn("bound", F.min(farthest).over(of_place))
        nodes = occupied.where(nearest * (1 - MARGIN) <= F.col("bound") * (1 + MARGIN)).drop("bound").checkpoint()
        inner = nodes.where(~F.col("leaf")).select("g", "box", *pos, *[F.col(c).alias(f"u{i}") for i, c in enumerate(cell)])
        if inner.isEmpty():
            return nodes.select("g", "box", *pos, "lvl", *cell)
        level += 1
        up = {f"u{i}": F.shiftright(F.col(c), 1) for i, c in enumerate(cell)}
        children = pyramid.where(F.col("lvl") == level).withColumns(up)
        opened = inner.join(children, ["g", *up]).select(*nodes.columns)
        nodes = nodes.where("leaf").unionByName(opened)


def _nearest(places: DataFrame, dims: int, crowded_cell: int) -> DataFrame:
    """(g, position) -> squared distance to the nearest other object; NULL if there is none."""
    grid = _Grid(dims)
    pos, cell = grid.pos, grid.cell
    b_pos = [f"q{i}" for i in range(dims)]
    n = F.pow(F.lit(2.0), F.col("lvl"))
    leaves = _start_levels(places, dims, crowded_cell).withColumns(grid.cells(n)).checkpoint()
    single = leaves.where(F.col("m") == 1)
    place = ["g", "box", *pos, "lvl"]

    def closest(queries: DataFrame, reached: DataFrame) -> DataFrame:
        # An inner join, so that a crowded cell on either side can be split at run time; places
        # that reach nothing come back through the union.
        met = reached.where(grid.differs(b_pos)).select(*place, grid.distance2(b_pos).alias("d2"))
        alone = queries.select(*place, F.lit(None).cast("double").alias("d2"))
        return met.unionByName(alone).groupBy(*place).agg(F.min("d2").alias("d2"))

    other = [F.col(p).alias(q) for p, q in zip(pos, b_pos, strict=True)]
    levels, _ = materialise_small(single.select("g", "lvl").distinct())
    others = places.join(levels, "g").withColumns(grid.cells(n)).select("g", "lvl", *cell, *other)
    around = closest(single, grid.spread(single, n, place).join(others, ["g", "lvl", *cell])).checkpoint()
    width = F.col("box") / n * F.lit(1 - MARGIN)
    final = (F.col("lvl") <= 1) | F.coalesce(F.col("d2") <= width * width, F.lit(False))
    found = [
        places.where(F.col("m") > 1).select("g", *pos, F.lit(0.0).alias("d2")),
        around.where(final).select("g", *pos, "d2"),
    ]
    pending = around.where(~final).drop("d2")
    if not pending.isEmpty():
        leaves_met, _ = materialise_small(_leaves_in_reach(pending, _pyramid(leaves, dims), dims))
        reached = leaves_met.join(leaves.select("g", "lvl", *cell, *other), ["g", "lvl", *cell])
        rest = closest(pending.withColumn("lvl", F.lit(0)), reached.withColumn("lvl", F.lit(0)))
        found.append(rest.select("g", *pos, "d2"))
    return reduce(DataFrame.unionByName, found)


def _back_to_objects(
    df: DataFrame, group: str, key: Sequence[str], coords: Sequence[str], found: DataFrame
) -> DataFrame:
    pos = [f"p{i}" for i in range(len(coords))]
    objects = df.select(
        *key,
        _group_key(group),
        *[(F.col(c).cast("double") + F.lit(0.0)).alias(p) for c, p in zip(coords, pos, strict=True)],
    )
    return objects.join(found, ["g", *pos])


def radius_count(
    df: DataFrame,
    group: str,
    key: Sequence[str],
    coords: Sequence[str],
    box: str,
    radius: float,
    name: str = "n_within",
    crowded_pair: int = CROWDED_PAIR,
) -> DataFrame:
    """Objects of the same group at torus distance <= radius, without the object itself."""
    ensure_checkpoint_dir(df.sparkSession)
    places = distinct_places(df, group, coords, box).checkpoint()
    counts = _radius_counts(places, len(coords), radius, crowded_pair)
    joined = _back_to_objects(df, group, key, coords, counts)
    return joined.select(*key, F.col("g.v").alias(group), (F.col("n_within") - 1).alias(name))


def nearest_distance(
    df: DataFrame,
    group: str,
    key: Sequence[str],
    coords: Sequence[str],
    box: str,
    name: str = "nearest",
    crowded_cell: int = CROWDED_CELL,
) -> DataFrame:
    """Torus distance to the nearest other object of the same group; infinite without any."""
    ensure_checkpoint_dir(df.sparkSession)
    places = distinct_places(df, group, coords, box).checkpoint()
    nearest = _nearest(places, len(coords), crowded_cell)
    joined = _back_to_objects(df, group, key, coords, nearest)
    distance = F.coalesce(F.sqrt("d2"), F.lit(float("inf")))
    return joined.select(*key, F.col("g.v").alias(group), distance.alias(name))


def periodic_neighbours(
    df: DataFrame,
    group: str,
    key: Sequence[str],
    coords: Sequence[str],
    box: str,
    radius: float,
    nearest_name: str = "nearest",
    count_name: str = "n_within",
    crowded_cell: int = CROWDED_CELL,
    crowded_pair: int = CROWDED_PAIR,
) -> DataFrame:
    """Both neighbour features at once, sharing the distinct positions and the join back."""
    ensure_checkpoint_dir(df.sparkSession)
    dims = len(coords)
    pos = [f"p{i}" for i in range(dims)]
    places = distinct_places(df, group, coords, box).checkpoint()
    both = _nearest(places, dims, crowded_cell).join(
        _radius_counts(places, dims, radius, crowded_pair), ["g", *pos]
    )
    joined = _back_to_objects(df, group, key, coords, both)
    return joined.select(
        *key,
        F.col("g.v").alias(group),
        F.coalesce(F.sqrt("d2"), F.lit(float("inf"))).alias(nearest_name),
        (F.col("n_within") - 1).alias(count_name),
    )
