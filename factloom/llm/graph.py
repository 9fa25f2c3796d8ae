"""Connected components as DataFrame joins: alternating large-star and small-star steps.

Each step needs the smallest neighbour of a node, a combinable minimum, so a hub is never gathered;
edges and labels stay distributed, and every round is written to the shared folder. Rounds end when
each component is a star, which a count tells; a round more would only repeat it. Components that
are known already are carried on by ``merged``, which looks at new edges alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, row_bytes, scratch, small, stored


def _smallest(pairs: DataFrame, nodes: int) -> DataFrame:
    """(u, m): the smallest neighbour of each node, of which there are at most ``nodes``; written only where they may not fit a broadcast."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return F.broadcast(low) if nodes * row_bytes(low) <= BROADCAST_BYTES else small(stored(low, "smallest"))


def _unsettled(edges: DataFrame) -> tuple[int, int]:
    """How many edges (u > v) there are, and how many nodes have two smaller neighbours or smaller and larger ones: none if all components are stars around their smallest nodes."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    per_node = ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("_low"))
    n, bad = per_node.agg(F.sum("up"), F.count(F.when((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("_low") == 0)), 1))).first()
    return n or 0, bad


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) to (node, component): the smallest node of each component, for every node that has an edge. The result is stored."""
    with scratch(edges.sparkSession) as keep:
        edges = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        while True:
            n, bad = _unsettled(edges)
            if not bad:
                break
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = _smallest(both, 2 * n)
            low = low.select("u", F.least("u", "m").alias("m"))
            large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
            large = stored(large, "large")
            low = _smallest(large, 2 * n)
            small_star = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
            edges = stored(small_star, "edges")
        stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return keep(stored(stars.union(stars.select("component", "component")).distinct(), "components"))


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, component) of stored ``labels``, as ``components`` gives them, with ``edges`` (u, v) besides: known components count as nodes. Stored."""
    with scratch(edges.sparkSession) as keep:
        known = small(labels)
        ends = edges.join(known.select(F.col("node").alias("u"), F.col("component").alias("_a")), "u", "left").join(known.select(F.col("node").alias("v"), F.col("component").alias("_b")), "v", "left")
        between = stored(ends.select(F.coalesce("_a", "u").alias("u"), F.coalesce("_b", "v").alias("v")).filter("u != v"), "between")
        if between.isEmpty():
            return labels
        found = components(between)
        moved = small(found.select(F.col("node").alias("component"), F.col("component").alias("_to")))
        old = labels.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        new = found.join(known.select("node"), "node", "left_anti")
        return keep(stored(old.union(new), "components"))
