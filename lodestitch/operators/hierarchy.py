"""Closure, distance and relations in an is-a hierarchy: edges of (parent, child); cycles are allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.functions.storage import Scratch

from . import distances


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, min_steps) of all pairs linked by a path.

    A frontier of shortest paths grows upwards by one step a round, which needs only the edges above parents; a round
    is written out, so the plan stays short and a lost executor costs one round. A node is its own ancestor only
    through a cycle.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    e = scratch.keep(edges.select("parent", "child").filter("parent IS NOT NULL AND child IS NOT NULL").distinct(), "edges")
    above = scratch.keep(distances.inner(e, "child").select(F.col("child").alias("ancestor"), "parent"), "inner")
    known = e.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).cast("long").alias("min_steps"))
    level, steps = known, 1
    while True:
        steps += 1
        grown = level.select("ancestor", "descendant").join(above, "ancestor").select(F.col("parent").alias("ancestor"), "descendant").distinct()
        level = scratch.keep(grown.join(known, ["ancestor", "descendant"], "left_anti").withColumn("min_steps", F.lit(steps).cast("long")), "level")
        if level.isEmpty():
            return known
        known = known.unionByName(level)


def ancestor_distances(edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, steps), each node being its own ancestor at 0."""
    reach = closure(edges) if reach is None else reach
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("node")).filter("node IS NOT NULL").distinct()
    up = reach.filter("ancestor != descendant").select(F.col("descendant").alias("node"), "ancestor", F.col("min_steps").alias("steps"))
    return up.unionByName(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("steps")))


def distance(pairs: DataFrame, edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(a, b, distance): fewest steps over a common ancestor; 0 for equal ids, null without one.

    Without a closure at hand the pairs are searched from both ends (``distances.search``).
    """
    if reach is None:
        return distances.search(pairs, edges)
    up = ancestor_distances(edges, reach)
    p = pairs.select("a", "b").distinct()
    left = up.select(F.col("node").alias("a"), "ancestor", F.col("steps").alias("up_a"))
    right = up.select(F.col("node").alias("b"), "ancestor", F.col("steps").alias("up_b"))
    met = p.filter("a != b").join(left, "a").join(right, ["b", "ancestor"]).groupBy("a", "b").agg(F.min(F.col("up_a") + F.col("up_b")).alias("d"))
    return p.join(met, ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), F.lit(0).cast("long")).otherwise(F.col("d")).alias("distance"))


def depth(reach: DataFrame) -> DataFrame:
    """(node, n_ancestors, max_steps): ancestor count and the longest of the shortest paths up."""
    return reach.groupBy(F.col("descendant").alias("node")).agg(F.count(F.lit(1)).alias("n_ancestors"), F.max("min_steps").alias("max_steps"))


def relation(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """(a, b, relation): equal, broader (a above b), narrower or lateral."""
    return distances.compared(pairs, reach)


def related_candidates(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """(hpo_id, broader, narrower): targets of one concept of which one is above the other (source collapse)."""
    p = pairs.select("hpo_id", "sct_id").distinct()
    up = p.withColumnRenamed("sct_id", "descendant").join(reach.filter("ancestor != descendant"), "descendant")
    up = up.select("hpo_id", F.col("ancestor").alias("broader"), F.col("descendant").alias("narrower"))
    return up.join(p.withColumnRenamed("sct_id", "broader"), ["hpo_id", "broader"], "left_semi")


def target_collapse(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """(sct_id, broader, narrower): source concepts, one above the other, that share a target."""
    swapped = pairs.select(F.col("sct_id").alias("hpo_id"), F.col("hpo_id").alias("sct_id"))
    return related_candidates(swapped, reach).withColumnRenamed("hpo_id", "sct_id")


def cross_reversal(pairs: DataFrame, source_reach: DataFrame, target_reach: DataFrame) -> DataFrame:
    """Source child below source parent, but the parent's target below the child's target."""
    p = pairs.select("hpo_id", "sct_id").distinct()
    child = p.select(F.col("hpo_id").alias("child"), F.col("sct_id").alias("child_sct"))
    parent = p.select(F.col("hpo_id").alias("parent"), F.col("sct_id").alias("parent_sct"))
    over = source_reach.filter("ancestor != descendant").select(F.col("ancestor").alias("parent"), F.col("descendant").alias("child"))
    down = target_reach.filter("ancestor != descendant").select(F.col("ancestor").alias("child_sct"), F.col("descendant").alias("parent_sct"))
    return child.join(over, "child").join(parent, "parent").join(down, ["child_sct", "parent_sct"], "left_semi").select("child", "child_sct", "parent", "parent_sct").distinct()
