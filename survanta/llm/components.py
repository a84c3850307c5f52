"""Connected components of a table of links by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reachable.

    Each round every node points at its smallest neighbour, pointers are followed three times more, and both ends of all
    links are replaced. The largest node of a component always moves, so it ends; stars take one round, chains shrink by
    a factor each round. All steps are groupings with map-side minima and joins. Null and self links are ignored; no
    links give no nodes.
    """
    edges = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mapping = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")), "pointers")
        for _ in range(2):
            nxt = point.select(F.col("node").alias("to"), F.col("to").alias("then"))
            point = stored(point.join(nxt, "to", "left").select("node", F.coalesce("then", "to").alias("to")), "pointers")
        if mapping is None:
            mapping = point.withColumnRenamed("to", "component")
        else:
            later = point.select(F.col("node").alias("component"), F.col("to").alias("then"))
            mapping = mapping.join(later, "component", "left").select("node", F.coalesce("then", "component").alias("component"))
        mapping = stored(mapping, "components")
        ends = [point.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").filter("a_to <> b_to")
        edges = stored(moved.select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return mapping
