"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.batches import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: larger neighbours move to the least neighbour. Small: smaller ones and the node itself do."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # a table of its own: a join of two plain inputs can split the links of a node that has very many
    least = store(both.groupBy("a").agg(F.min("b").alias("m")), "least")
    joined = both.join(least, "a").withColumn("m", F.least("a", "m"))
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); the label is the least node of its component.

    Each round is two aggregates and two joins over the edges and ends as a table; the number of edges never
    grows. Loops are ignored; an empty table gives an empty one.
    """
    edges = store(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        before = state
        edges = store(_star(_star(edges, True), False), "edges")
