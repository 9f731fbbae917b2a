"""Connected components by label propagation with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.workspace import stored


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected to) of every end of `links` (a, b: long).

    Each round gives a node the smallest root among its neighbours' and its
    own, hooks that root under it, and shortens every chain of roots by half;
    rounds grow with the logarithm of the longest path.  Hooking keeps the
    smallest of many proposals by partial aggregation, so a hub costs no more
    than its links.
    """
    both = stored(links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select("b", "a")).distinct(), "links")
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "roots")
    while True:
        # Roots of a link's two ends that differ: the larger is to go under the smaller.
        ends = both.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        hooks = ends.filter("ra > rb").groupBy(F.col("ra").alias("over")).agg(F.min("rb").alias("under"))
        hooks = stored(hooks, "hooks")
        if hooks.isEmpty():
            return roots
        moved = roots.join(hooks, roots.root == hooks.over, "left").select("node", F.coalesce("under", "root").alias("root"))
        roots = _jumped(stored(moved, "roots"))


def _jumped(roots: DataFrame) -> DataFrame:
    above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stored(roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
