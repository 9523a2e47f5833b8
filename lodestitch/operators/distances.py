"""Distances, relations and depths in an is-a hierarchy for the ids that occur, without a closure of the whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestitch.functions.storage import Scratch

from . import ends

#: A hierarchy of up to so many edges, whose ids take up to so many bytes as text, is held by every task.
EDGES, EDGE_BYTES = 1 << 21, 64 << 20


def inner(up: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """The edges above nodes that are parents themselves: all that a climb needs after its first step."""
    return up.join(up.select(F.col(parent).alias(node)).distinct(), node, "left_semi")


def search(pairs: DataFrame, edges: DataFrame, trace: list[dict] | None = None) -> DataFrame:
    """(a, b, distance) of the distinct ``pairs``: fewest is-a steps from ``a`` up to a common ancestor and down to ``b``.

    Equal ids have 0, also unknown ones; without a common ancestor, or with a null id, the distance is null. ``edges``
    are (parent, child); cycles, loops, repeated and null ones are allowed, and paths over a common descendant don't
    count.

    Both ends of the open pairs climb one step a round, each id once however many pairs it is in. After ``k`` rounds
    every ancestor not met yet is over ``k`` steps from one of the ends, so a pair is settled as soon as its sum is at
    most ``k + 1`` (``k + 2`` where neither end has children, as then it is a step from the other too), or when neither
    end has an ancestor to climb from. Ids that no open pair needs stop climbing. A round writes the ancestors met so
    far and the open pairs, and drops what it supersedes. ``trace`` gets each round's open pairs and
    ancestors.

    Where the hierarchy is small enough (EDGES, EDGE_BYTES) and no ``trace`` is asked for, each task holds it and
    searches its own pairs by the same rule (``ends.distances``), without rounds.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "distances")
    distinct = scratch.keep(pairs.select("a", "b").distinct(), "pairs")
    up = scratch.keep(edges.select(F.col("child").alias("node"), "parent").filter("node != parent").distinct(), "edges")
    done = [distinct.filter("a = b").withColumn("distance", F.lit(0).cast("long")), distinct.filter("a IS NULL OR b IS NULL").withColumn("distance", F.lit(None).cast("long"))]
    if trace is None and _at_hand(distinct, up):
        found = scratch.keep(_held(distinct.filter("a != b"), up), "found")
        scratch.drop(up)
        return done[0].unionByName(done[1]).unionByName(found)
    above = scratch.keep(inner(up), "inner")
    over = up.select("parent").distinct()
    state = distinct.filter("a != b")
    for c in "ab":
        state = state.join(over.select(F.col("parent").alias(c), F.lit(0).alias(f"leaf_{c}")), c, "left")
    leaves = F.coalesce("leaf_a", "leaf_b", F.lit(1)).alias("leaves")
    state = scratch.keep(state.select("a", "b", F.lit(None).cast("long").alias("distance"), leaves, F.lit(False).alias("settled")), "state")
    settled, reach, k = [], None, 0
    while True:
        todo = state.filter("NOT settled").select("a", "b", "leaves")
        n_open = todo.count()
        if not n_open:
            break
        ids = todo.select(F.explode(F.array("a", "b")).alias("start")).distinct()
        old = reach
        if reach is None:
            known = ids.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("steps"))
        else:
            known = reach.join(ids, "start", "left_semi")
        k += 1
        climbed = known.filter(F.col("steps") == k - 1).join(up if k == 1 else above, "node").select("start", F.col("parent").alias("node"), F.lit(k).cast("long").alias("steps"))
        reach = scratch.keep(known.unionByName(climbed).groupBy("start", "node").agg(F.min("steps").alias("steps")), "reach")
        left = reach.select(F.col("start").alias("a"), "node", F.col("steps").alias("up_a"))
        right = reach.select(F.col("start").alias("b"), "node", F.col("steps").alias("up_b"))
        met = todo.select("a", "b").join(left, "a").join(right, ["b", "node"]).groupBy("a", "b").agg(F.min(F.col("up_a") + F.col("up_b")).alias("distance"))
        climbing = reach.filter(F.col("steps") == k).join(above.select("node").distinct(), "node", "left_semi").select(F.col("start").alias("id"), F.lit(True).alias("on")).distinct()
        ends = [climbing.select(F.col("id").alias(c), F.col("on").alias(f"on_{c}")) for c in "ab"]
        after = todo.join(met, ["a", "b"], "left").join(ends[0], "a", "left").join(ends[1], "b", "left")
        stuck = F.col("on_a").isNull() & F.col("on_b").isNull()
        before, state = state, scratch.keep(after.select("a", "b", "distance", "leaves", (F.coalesce(F.col("distance") <= k + 1 + F.col("leaves"), F.lit(False)) | stuck).alias("settled")), "state")
        if trace is not None:
            trace.append({"round": k, "open": n_open, "ancestors": reach.count()})
        settled.append(state.filter("settled").select("a", "b", "distance"))
        if k == 1:
            scratch.drop(before)
        if old is not None:
            scratch.drop(old)
    out = done[0].unionByName(done[1])
    for x in settled:
        out = out.unionByName(x)
    return out


def _at_hand(pairs: DataFrame, up: DataFrame) -> bool:
    """Whether a task can hold ``up``, and its ids are numbers or text of the pairs' type."""
    kinds = {df.schema[c].dataType.simpleString() for df, c in ((pairs, "a"), (pairs, "b"), (up, "node"), (up, "parent"))}
    if len(kinds) > 1 or not kinds <= {"int", "bigint", "string"}:
        return False
    n, size = up.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("node").cast("string")) + F.octet_length(F.col("parent").cast("string")))).first()
    return n <= EDGES and (size or 0) <= EDGE_BYTES


def _held(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """``search`` of different ids, each task holding the hierarchy."""
    spark = pairs.sparkSession
    edges = up.select("node", "parent").toArrow()
    ids = pc.unique(pa.chunked_array([*edges["node"].chunks, *edges["parent"].chunks], edges.schema.field("node").type))
    child, parent = (pc.index_in(edges[c], value_set=ids).to_numpy() for c in ("node", "parent"))
    shared = spark.sparkContext.broadcast((ids, ends.hierarchy(len(ids), child, parent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, h = shared.value
        for batch in batches:
            a, b = (pc.fill_null(pc.index_in(c, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            d, both = np.full(len(a), -1, np.int64), (a >= 0) & (b >= 0)
            d[both] = ends.distances(h, a[both], b[both])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, mask=d < 0)], names=["a", "b", "distance"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.repartition(4 * spark.sparkContext.defaultParallelism, "a", "b").mapInArrow(run, f"a {kind}, b {kind}, distance long")


def climb(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node, steps): each distinct ``id`` with itself at 0 and all its ancestors by their fewest steps.

    Only what lies above ``ids`` is walked; cycles end where they come back. A round writes the ancestors that it
    meets first.
    """
    scratch = Scratch(ids.sparkSession, "climb")
    up = scratch.keep(edges.select(F.col("child").alias("node"), "parent").filter("node != parent").distinct(), "edges")
    above = scratch.keep(inner(up), "inner")
    level = known = scratch.keep(ids.select(F.col(ids.columns[0]).alias("start")).filter("start IS NOT NULL").distinct().select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("steps")), "known")
    k = 0
    while True:
        climbed = level.select("start", "node").join(above if k else up, "node").select("start", F.col("parent").alias("node"))
        k += 1
        level = scratch.keep(climbed.distinct().join(known.select("start", "node"), ["start", "node"], "left_anti").withColumn("steps", F.lit(k).cast("long")), "known")
        if level.isEmpty():
            break
        known = known.unionByName(level)
    scratch.drop(up, above)
    return known


def relations(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """(a, b, relation) of the distinct ``pairs`` with both ids: equal, broader (a above b), narrower or lateral.

    ``up`` is what ``climb`` made of at least the pairs' ids. Of two ids in one cycle the first is broader.
    """
    return compared(pairs.filter("a IS NOT NULL AND b IS NOT NULL"), up.select(F.col("node").alias("ancestor"), F.col("start").alias("descendant")))


def compared(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """``relations`` of pairs by (ancestor, descendant); ids that are null are lateral.

    Pairs and reach are dealt once, by their two ids in order, and added up as bits: the pair is asked for as it stands
    (1) or turned (2), its first id is above the other (4) or below it (8).
    """

    def in_order(df: DataFrame, a: str, b: str, yes: int, no: int) -> DataFrame:
        up = F.col(a) <= F.col(b)
        return df.select(F.when(up, F.col(a)).otherwise(F.col(b)).alias("x"), F.when(up, F.col(b)).otherwise(F.col(a)).alias("y"), F.when(up, yes).otherwise(no).alias("bits"))

    every = in_order(pairs, "a", "b", 1, 2).unionByName(in_order(reach.filter("ancestor != descendant"), "ancestor", "descendant", 4, 8))
    has = lambda bit: F.col("bits").bitwiseAND(bit) != 0

    def asked(a: str, b: str, bit: int, over: int, under: int) -> Column:
        kind = F.when(F.col(a) == F.col(b), "equal").when(has(over), "broader").when(has(under), "narrower").otherwise("lateral")
        return F.when(has(bit), F.struct(F.col(a).alias("a"), F.col(b).alias("b"), kind.alias("relation")))

    met = every.repartition("x", "y").groupBy("x", "y").agg(F.bit_or("bits").alias("bits")).filter(has(3))
    return met.select(F.explode(F.array_compact(F.array(asked("x", "y", 1, 4, 8), asked("y", "x", 2, 8, 4)))).alias("r")).select("r.a", "r.b", "r.relation")


def related_pairs(members: DataFrame, up: DataFrame, by: list[str]) -> DataFrame:
    """(*by, broader, narrower): of each group's ids (column ``id``) those of which one is above the other, each two once.

    Of two ids in one cycle the smaller counts as the broader. The groups are arbitrary sets, not only one concept's
    targets.
    """
    m = members.select(*by, "id").distinct()
    over = up.filter("start != node").select(F.col("start").alias("id"), F.col("node").alias("broader"))
    met = m.join(over, "id").select(*by, "broader", F.col("id").alias("narrower"))
    met = met.join(m.withColumnRenamed("id", "broader"), [*by, "broader"], "left_semi")
    low, high = F.least("broader", "narrower"), F.greatest("broader", "narrower")
    once = met.groupBy(*by, low.alias("low"), high.alias("high")).agg(F.min("broader").alias("broader"))
    return once.select(*by, "broader", F.when(F.col("broader") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("narrower"))
