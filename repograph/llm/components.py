"""Connected components by contraction.

Each round maps every node to its smallest neighbour (or itself), follows these steps to local minima
and contracts the edges onto them, so the edge table shrinks from round to round.  Every round is
written to the shared folder; only counts reach the driver.  The last root of a component is its smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.tables import store


def _any(df: DataFrame) -> bool:
    return bool(df.head(1))


def _roots(parents: DataFrame) -> DataFrame:
    """Follow parents until all nodes point to roots."""

    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = store(
            parents.join(up, "parent", "left").select(
                "node", F.coalesce("next", "parent").alias("parent"),
                (F.col("next") != F.col("parent")).alias("moved")))
        parents = jumped.select("node", "parent")
        # Where no parent moved, the parents were roots before this step.
        if not _any(jumped.where("moved")):
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); loops and nulls are left out."""

    edges = store(edges.select("a", "b").where("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    while _any(edges):
        # An edge offers its smaller end to both ends; the smallest offer is the parent.
        offers = edges.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("parent"))
        parents = _roots(offers.groupBy("node").agg(F.min("parent").alias("parent")))
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            step = parents.select(F.col("node").alias("component"), F.col("parent").alias("next"))
            labels = store(labels.join(step, "component", "left").select(
                "node", F.coalesce("next", "component").alias("component")))
        ends = parents.select(F.col("node").alias("b"), F.col("parent").alias("to_b"))
        starts = parents.select(F.col("node").alias("a"), F.col("parent").alias("to_a"))
        edges = store(
            edges.join(starts, "a").join(ends, "b").where("to_a != to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
