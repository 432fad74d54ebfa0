"""Walks over parent-child tables, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylake.sources.staging import staged


def descendants(edges: DataFrame, roots: DataFrame, most: int = 1000) -> DataFrame:
    """root, node, depth of everything below the roots. edges: parent, child; roots: root.

    One join a level, staged, so the lineage stays short and no row limit applies. Cycles end where a root meets a node
    again. A tree deeper than `most` levels is an error.
    """
    step = roots.select("root", F.col("root").alias("node"))
    found = staged(step.select("root", "node", F.lit(0).alias("depth")), "walk")
    front = found
    for depth in range(1, most + 1):
        front = front.join(edges, front["node"] == edges["parent"]).select("root", F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        front = staged(front.join(found.select("root", "node"), ["root", "node"], "left_anti"), "walk")
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    raise RuntimeError(f"the tree is deeper than {most} levels")


def active_leaves(edges: DataFrame, roots: DataFrame, kinds: DataFrame, skipped: str) -> DataFrame:
    """Descendants but those of the kind `skipped`, below which the walk goes on; roots are not among them."""
    return descendants(edges, roots).where("depth > 0").join(kinds, "node").where(F.col("kind") != skipped)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every node that a root reaches, itself included: supertypes, hierarchies."""
    return descendants(edges, roots).select("root", "node")
