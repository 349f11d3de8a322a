"""Connected components of a table of links, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noticeloom.session import staged


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, root) whose roots point to themselves, by pointer jumping."""
    while True:
        above = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = staged(parents.join(above, "root").select("node", "root", "next"), "jumped")
        moved = not jumped.filter("next <> root").isEmpty()
        parents = jumped.select("node", F.col("next").alias("root"))
        if not moved:
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the smallest node it is connected with.

    Every round hangs each node under its smallest neighbour and replaces the trees by their
    roots, so at least half of the nodes that still have links go. Roots are tree minima, hence
    the last root of a component is its smallest node.
    """
    links = staged(links.select("a", "b").filter("a <> b").distinct(), "links")
    found: DataFrame | None = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parents = staged(lowest.select("node", F.least("node", "low").alias("root")), "parents")
        roots = _roots(parents)
        if found is None:
            found = roots
        else:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            merged = found.join(above, "root", "left")
            found = staged(merged.select("node", F.coalesce("next", "root").alias("root")), "found")
        ends = [roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")) for end in "ab"]
        shrunk = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        links = staged(shrunk.filter("a <> b").distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
