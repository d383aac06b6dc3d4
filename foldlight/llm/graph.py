"""Connected components of large edge tables by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight.session import materialize


def jump(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, root) whose every root is smaller than its node.

    The path to the root halves in each round; a round is one equality join.
    """
    while True:
        above = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        parents = materialize(
            parents.join(above, "root", "left").select(
                "node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")
            ),
            "roots",
        )
        if parents.filter("moved").isEmpty():
            return parents.select("node", "root")


def relabel(edges: DataFrame, roots: DataFrame, *ends: str) -> DataFrame:
    """``edges`` with each end replaced by its root; rows whose ends meet are dropped."""
    for end in ends:
        to = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    return edges.filter(F.col(ends[0]) != F.col(ends[1]))


def merge(roots: DataFrame | None, forest: DataFrame) -> DataFrame:
    """Roots after the roots themselves were hooked by ``forest`` (node, root)."""
    if roots is None:
        return forest
    top = forest.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    moved = roots.join(top, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    return materialize(moved.union(forest), "roots")


def components(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame | None:
    """(node, root) for every node that is not its own root, given edges (a, b).

    Each round hooks a root to the smallest root beside it, which leaves a
    forest, and contracts. ``roots`` continues from an earlier result whose roots
    the edges already name.
    """
    while not edges.isEmpty():
        forest = edges.groupBy(F.greatest("a", "b").alias("node")).agg(
            F.min(F.least("a", "b")).alias("root")
        )
        forest = jump(materialize(forest, "hooks"))
        roots = merge(roots, forest)
        edges = materialize(relabel(edges, forest, "a", "b").select("a", "b").distinct(), "edges")
    return roots
