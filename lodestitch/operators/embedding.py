"""Range search over term vectors: all pairs above a cosine, in blocks, of which those too far apart are skipped."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.constants import COSINE_THRESHOLD
from lodestitch.functions.storage import Scratch

#: Vectors of one block on either side: a product of two blocks takes 4 MB.
BLOCK = 1024
#: Source vectors are broadcast only up to this many bytes; beyond it both sides are dealt in tiles of so many blocks.
BROADCAST_BYTES, TILE = 64 << 20, 64
#: Vectors that stand for neighbourhoods, at most; and shells of equal angle around each.
PIVOTS, SHELLS = 64, 16
#: Angles are widened by so much, over the rounding of single floats.
SLACK = 1e-3
#: Texts an embedder gets at once.
TERMS = 128


class Group(NamedTuple):
    """Vectors around one pivot: their number, and their least and greatest angle to it."""

    pivot: int
    shell: int
    n: int
    low: float
    high: float


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of unit length as single floats; zero rows stay."""
    m = m.astype(np.float32)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All products of two blocks in doubles, for the confidences of what single floats have found."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return x @ y.T / np.sqrt(np.outer((x * x).sum(axis=1), (y * y).sum(axis=1)))


def _singles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows' pairs in single floats, summed in turn with one rounding a step, as a fused loop does.

    Products of singles are exact in doubles, so rounding each sum from there is that of the fused step.
    """

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a), np.float32)
        for k in range(a.shape[1]):
            total = (a[:, k].astype(np.float64) * b[:, k] + total).astype(np.float32)
        return total

    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def _confidences(x: np.ndarray, y: np.ndarray, at: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """The same for some pairs: all products at once only where these are many."""
    if 8 * len(at) > len(x) * len(y):
        return _cosines(x, y)[at, bt]
    x, y = x.astype(np.float64), y.astype(np.float64)
    return np.einsum("ij,ij->i", x[at], y[bt]) / np.sqrt((x * x).sum(axis=1)[at] * (y * y).sum(axis=1)[bt])


def over(x: np.ndarray, y: np.ndarray, threshold: float, later: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` with a cosine strictly over ``threshold``; with ``later`` only those after ``x``'s row.

    The product of the blocks decides all pairs but those within its rounding of the threshold, which ``_singles``
    decides, so that no pair depends on the blocks' shapes.
    """
    c = _unit(x) @ _unit(y).T
    margin = 4 * (x.shape[1] + 8) * float(np.finfo(np.float32).eps)
    found = c > threshold - margin
    at, bt = np.nonzero(np.triu(found, 1) if later else found)
    near = np.flatnonzero(c[at, bt] <= threshold + margin)
    drop = near[~(_singles(x[at[near]], y[bt[near]]) > threshold)]
    return np.delete(at, drop), np.delete(bt, drop)


def _flat(rows: pa.ListArray) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _clean(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("v").cast("array<float>").alias("v")).filter("id IS NOT NULL AND size(v) > 0").distinct()


def pivots(vectors: DataFrame, most: int) -> np.ndarray:
    """Up to ``most`` unit vectors far from each other, of the ``16 * most`` with the smallest hashes: farthest first."""
    sample = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(16 * most).toArrow().column(0).combine_chunks()
    if not len(sample):
        return np.zeros((0, 0), np.float32)
    m = _unit(_flat(sample))
    m = m[np.linalg.norm(m, axis=1) > 0]
    if not len(m):
        return np.zeros((0, 0), np.float32)
    chosen = [0]
    near = m @ m[0]
    while len(chosen) < min(most, len(m)):
        k = int(near.argmin())
        if near[k] > 1 - SLACK:
            break
        chosen.append(k)
        near = np.maximum(near, m @ m[k])
    return m[chosen]


def grouped(vectors: DataFrame, points: np.ndarray) -> DataFrame:
    """(id, v, pivot, shell, angle): each vector under its nearest pivot; zero vectors are left out, as they match nothing."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _unit(_flat(b.column("v")))
            b, m = b.filter(pa.array(np.linalg.norm(m, axis=1) > 0)), m[np.linalg.norm(m, axis=1) > 0]
            near = m @ points.T
            pivot = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(m)), pivot].astype(np.float64), -1, 1))
            shell = np.minimum((angle / math.pi * SHELLS).astype(np.int32), SHELLS - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot.astype(np.int32)), pa.array(shell), pa.array(angle)], names=["id", "v", "pivot", "shell", "angle"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(place, f"id {kind}, v array<float>, pivot int, shell int, angle double")


def groups(placed: DataFrame) -> list[Group]:
    """At most PIVOTS * SHELLS rows."""
    g = placed.groupBy("pivot", "shell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    return sorted(Group(*r) for r in g.collect())


def least_angles(left: list[Group], right: list[Group], points: np.ndarray) -> np.ndarray:
    """For each pair of groups an angle that none of their vectors' pairs falls below, by the triangle inequality.

    For ``x`` around pivot ``p`` and ``y`` around ``q``, the angle of ``y`` and ``p`` lies between those of ``p`` and
    ``q`` less and plus that of ``y`` and ``q``; the angle of ``x`` and ``y`` is at least the gap to that of ``x`` and ``p``.
    """
    between = np.arccos(np.clip((points @ points.T).astype(np.float64), -1, 1))
    np.fill_diagonal(between, 0)
    phi = between[np.ix_([g.pivot for g in left], [g.pivot for g in right])]
    low_x, high_x = (np.array([x[k] for x in left])[:, None] for k in (3, 4))
    low_y, high_y = (np.array([y[k] for y in right])[None, :] for k in (3, 4))

    def gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(phi - high_b, low_b - phi) - high_a, low_a - phi - high_b)

    return np.maximum(0, np.maximum(gap(low_x, high_x, low_y, high_y), gap(low_y, high_y, low_x, high_x)) - 2 * SLACK)


class Search(NamedTuple):
    """Both sides in groups, which pairs of groups may hold a match, and whether no side has an id twice."""

    source: DataFrame
    target: DataFrame
    left: list[Group]
    right: list[Group]
    open: np.ndarray
    width: int
    single: bool


def _blocks_of(g: Group) -> int:
    return math.ceil(g.n / BLOCK)


def _plan(source: DataFrame, target: DataFrame | None, threshold: float) -> Search:
    scratch = Scratch(source.sparkSession, "cosine")
    s = _clean(source)
    n, width = s.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    points = pivots(s, min(PIVOTS, max(1, math.isqrt(n) // 2)))
    if not points.size:
        empty = s.limit(0).selectExpr("id", "v", "0 AS pivot", "0 AS shell", "0D AS angle")
        return Search(empty, empty, [], [], np.zeros((0, 0), bool), width, True)
    a = scratch.keep(grouped(s, points), "source")
    b = a if target is None else scratch.keep(grouped(_clean(target), points), "target")
    left = groups(a)
    right = left if target is None else groups(b)
    single = all(x.groupBy("id").count().filter("count > 1").isEmpty() for x in ((a,) if target is None else (a, b)))
    return Search(a, b, left, right, least_angles(left, right, points) <= math.acos(min(1, max(-1, threshold))) + SLACK, width, single)


def skipped(source: DataFrame, target: DataFrame | None = None, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """One row (n_block_pairs, n_skipped, skipped_share): block pairs of a search, and those that its bounds rule out."""
    p = _plan(source, target, threshold)
    both = np.outer([_blocks_of(g) for g in p.left], [_blocks_of(g) for g in p.right])
    every, left_out = int(both.sum()), int(both[~p.open].sum())
    return source.sparkSession.createDataFrame([(every, left_out, left_out / every if every else 0.0)], "n_block_pairs long, n_skipped long, skipped_share double")


def _blocked(df: DataFrame, known: list[Group], prefix: str) -> DataFrame:
    """Rows of about BLOCK vectors of one group, by the hash of the id: (<prefix>g, <prefix>b, <prefix>)."""
    spark = df.sparkSession
    of = spark.createDataFrame([(g.pivot, g.shell, i, _blocks_of(g)) for i, g in enumerate(known)], "pivot int, shell int, g int, n int")
    rows = df.join(F.broadcast(of), ["pivot", "shell"]).select("g", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("b"), F.struct("id", "v").alias("x"))
    return rows.groupBy(F.col("g").alias(f"{prefix}g"), F.col("b").alias(f"{prefix}b")).agg(F.collect_list("x").alias(prefix))


def _best(found: DataFrame, single: bool) -> DataFrame:
    """The best of each pair; where ids are single, each pair was found once and isn't moved."""
    best = found if single else found.groupBy("hpo_id", "sct_id").agg(F.max("confidence").alias("confidence"))
    return best.select("hpo_id", "sct_id", F.lit("embedding").alias("attribute"), "confidence")


def _tiled(p: Search, left: DataFrame, right: DataFrame, allowed: np.ndarray) -> DataFrame:
    """Blocks that may match, side by side: target blocks go once to each tile of TILE source blocks that they may match.

    A source tile goes to as many lots of target blocks as there are tiles, so a side is moved once a tile of the
    other, not once a block.
    """
    spark = left.sparkSession
    first = np.cumsum([0] + [_blocks_of(g) for g in p.left])
    tiles = lambda i: range(int(first[i]) // TILE, (int(first[i + 1]) - 1) // TILE + 1)
    meets = [(j, np.flatnonzero(allowed[:, j]).tolist()) for j in range(len(p.right))]
    meets = spark.createDataFrame([(j, m, sorted({t for i in m for t in tiles(i)})) for j, m in meets if m], "tg int, m array<int>, tiles array<int>")
    starts = spark.createDataFrame([(i, int(x)) for i, x in enumerate(first[:-1])], "sg int, first long")
    lots = max(1, math.ceil(sum(map(_blocks_of, p.right)) / TILE))
    right = right.join(F.broadcast(meets), "tg").withColumn("lot", F.pmod(F.xxhash64("tg", "tb"), F.lit(lots))).withColumn("tile", F.explode("tiles")).drop("tiles")
    left = left.join(F.broadcast(starts), "sg").withColumn("tile", F.floor((F.col("first") + F.col("sb")) / TILE).cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long")))).drop("first")
    return right.join(left, ["tile", "lot"]).filter(F.array_contains("m", F.col("sg")))


def _search(p: Search, threshold: float, same: bool) -> DataFrame:
    """The open block pairs, multiplied. With ``same`` each pair of blocks once and each pair of rows by ascending id."""
    spark = p.source.sparkSession
    left, right = _blocked(p.source, p.left, "s"), _blocked(p.target, p.right, "t")
    allowed = p.open & (np.tri(*p.open.shape, dtype=bool).T if same else True)
    if sum(g.n for g in p.left) * p.width * 4 <= BROADCAST_BYTES:
        # Which source groups a target group has to meet, with their blocks: at most the square of the groups.
        meets = [(j, [(i, _blocks_of(p.left[i])) for i in np.flatnonzero(allowed[:, j]).tolist()]) for j in range(len(p.right))]
        meets = spark.createDataFrame([x for x in meets if x[1]], "tg int, m array<struct<sg:int,n:int>>")
        right = right.join(F.broadcast(meets), "tg").select("tg", "tb", "t", F.inline("m")).withColumn("sb", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        met = right.join(F.broadcast(left), ["sg", "sb"])
    else:
        met = _tiled(p, left, right, allowed)
    one = (F.col("sg") == F.col("tg")) & (F.col("sb") == F.col("tb")) if same else F.lit(False)
    met = (met.filter("sg < tg OR sb <= tb") if same else met).select("s", "t", one.alias("one"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, one in zip(*batch.columns, strict=True):
                (ia, x), (ib, y) = ((r.values.field("id"), _flat(r.values.field("v"))) for r in (a, b))
                at, bt = over(x, y, threshold, one.as_py())
                sim = np.round(np.minimum(_confidences(x, y, at, bt), 1.0), 6) if len(at) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([ia.take(pa.array(at)), ib.take(pa.array(bt)), pa.array(sim)], ["hpo_id", "sct_id", "confidence"])

    schema = f"hpo_id {p.source.schema['id'].dataType.simpleString()}, sct_id {p.target.schema['id'].dataType.simpleString()}, confidence double"
    found = met.mapInArrow(multiply, schema)
    if same:
        found = found.filter("hpo_id != sct_id").select(F.least("hpo_id", "sct_id").alias("hpo_id"), F.greatest("hpo_id", "sct_id").alias("sct_id"), "confidence")
    return _best(found, p.single)


def cosine_join(source: DataFrame, target: DataFrame, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """(hpo_id, sct_id, attribute, confidence) of all pairs with a cosine strictly over ``threshold``; the best of a pair.

    Both sides are (id, v). Null vectors are left out, zero vectors match nothing. Confidence is taken in doubles,
    cut at 1 and rounded half to even at six places, after the test. Vectors are grouped by the nearest of at most PIVOTS pivots,
    taken from a bounded sample of the source, and by their angle to it; pairs of groups that are too far apart by the
    triangle inequality are skipped, which loses no pair, whatever the pivots (``skipped`` tells the share). Groups of
    any size are cut into blocks.
    """
    return _search(_plan(source, target, threshold), threshold, same=False)


def cosine_self_join(vectors: DataFrame, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """The same over one table: each pair of different ids once, the smaller first; each pair of blocks is multiplied once."""
    return _search(_plan(vectors, None, threshold), threshold, same=True)


class TermEmbedder:
    """Vectors of terms by a model behind a function of a list of texts.

    ``model`` runs on executors, up to ``batch`` texts at a time, and returns one row of numbers a text. Each distinct
    text is embedded once, however many concepts have it.
    """

    def __init__(self, model: Callable[[list[str]], np.ndarray], batch: int = TERMS) -> None:
        self.model, self.batch = model, batch

    def embed(self, terms: DataFrame, term: str = "term") -> DataFrame:
        """``terms`` with ``v``, of unit length; zero vectors stay zero, null terms get none."""
        model, batch = self.model, self.batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for at in range(0, len(f), batch):
                    texts = f["_term"].iloc[at : at + batch]
                    found = np.asarray(model(texts.tolist()))
                    if len(found) != len(texts):
                        raise ValueError(f"{len(texts)} texts got {len(found)} vectors")
                    yield pd.DataFrame({"_term": texts.to_numpy(), "v": list(_unit(found.reshape(len(texts), -1)))})

        distinct = terms.select(F.col(term).alias("_term")).filter("_term IS NOT NULL").distinct()
        got = distinct.mapInPandas(run, "_term string, v array<float>")
        return terms.drop("v").join(got, F.col(term) == F.col("_term"), "left").drop("_term")


def embedding_pairs(source: DataFrame, target: DataFrame, embedder: TermEmbedder, threshold: float = COSINE_THRESHOLD) -> DataFrame:
    """Candidate pairs of (concept_id, term) tables by the cosine of their terms; the best of a pair of concepts."""
    s, t = (embedder.embed(x.select(F.col("concept_id").alias("id"), "term")).select("id", "v") for x in (source, target))
    return cosine_join(s, t, threshold)
