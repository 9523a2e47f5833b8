"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

A window as similar as asked for shares a shingle with its item, so windows are cut where a document meets a
shingle of any item: such a place gives a start and a length, as the shingle stands in items of that length. Other
windows can't pass and aren't fingerprinted. Items of one length that share shingles share windows; which items a
window resembles is found by fingerprints alone: windows and items of one length meet in a multi-index of
``radius + 1`` bit blocks, of which any two fingerprints within the radius share one (pigeonhole). Fingerprints give
every distinct shingle the weight 1 on both sides, so a verbatim copy has its item's. ``radius`` follows from the
similarity: a plain similarity s of sets of one size is an angle of arccos(2s / (1 + s)), and the radius lies three
standard deviations beyond the bits that differ at that angle on average.

Pairs within the radius are verified by exact similarity of their shingles, weighted or plain, whichever is
greater. A shingle weighs 1 by the distinct item texts that hold it, in items and windows alike, and 1 if none does.

The shingles of the items are broadcast while they number at most ``broadcast_grams``; beyond that the joins
shuffle by shingle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stage
from .native import blank_split, letters_and_digits, once, rolling


def radius_for(similarity: float, bits: int = 64, deviations: float = 3.0) -> int:
    """Bits that fingerprints of sets this similar differ in, at most but for rare exceptions."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(bits - 1, math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p))))


def simhash(grams: Column) -> Column:
    """64-bit fingerprint of hashed features: bit b is set where more features have it than not."""

    def bit(b: Column) -> Column:
        total = F.aggregate(grams, F.lit(0), lambda s, g: s + 2 * F.call_function("getbit", g, b).cast("int") - 1)
        return F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(bit(b)))


def blocks(fingerprint: Column, radius: int) -> Column:
    """``radius + 1`` disjoint bit blocks, each with its number: fingerprints within the radius share one."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(*(F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) * 64 + i for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))))


def item_table(items: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Per item with at least ``k`` words: n_words, its distinct shingles with weights (1 by the distinct texts that hold the shingle), fingerprint."""
    words = items.select(F.col(key).alias("item_id"), once(blank_split(letters_and_digits(F.col(text)))).alias("words"))
    grams = words.select("item_id", F.size("words").alias("n_words"), once(rolling("words", k)).alias("gs")).filter(F.size("gs") > 0)
    # repeated item ids: the row with the smallest shingles stands for all with equal texts; others keep apart by text
    grams = grams.withColumn("item_key", F.xxhash64("item_id", "gs")).dropDuplicates(["item_key"])
    each = grams.select("item_id", "item_key", "n_words", F.xxhash64("gs").alias("text_key"), F.posexplode("gs").alias("ipos", "g"))
    df = each.groupBy("g").agg((1.0 / F.countDistinct("text_key")).alias("w"))
    own = each.groupBy("item_key", "item_id", "n_words", "g").agg(F.min("ipos").alias("ipos")).join(df, "g")
    table = own.groupBy("item_key", "item_id", "n_words").agg(F.sort_array(F.collect_list(F.struct("ipos", "g", "w"))).alias("own"))
    return table.withColumn("fp", simhash(F.col("own.g")))


def matches(
    docs: DataFrame,
    items: DataFrame,
    k: int = 5,
    min_similarity: float = 0.8,
    radius: int | None = None,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    broadcast_grams: int = 2_000_000,
) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming and similarity of the best window of each item in each document.

    Words are runs of letters and digits, lower-cased. Null texts have no words. Items and documents under ``k``
    words match nothing. Repeated rows of a document give one row for each match; repeated items likewise. Empty
    tables give no rows; extra columns are ignored. Ties in similarity: the smallest start. Null keys are keys. A
    document is cut in one task, whatever its length.
    """
    radius = radius_for(min_similarity) if radius is None else radius
    table = stage(item_table(items, item_key, item_text, k), "leak-items")
    grams = table.select("n_words", F.explode("own").alias("x")).select("n_words", F.col("x.ipos").alias("ipos"), F.col("x.g").alias("g"), F.col("x.w").alias("w")).distinct()
    mark = F.broadcast if grams.limit(broadcast_grams + 1).count() <= broadcast_grams else lambda x: x

    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    words = base.select("doc_id", F.xxhash64("t").alias("h"), once(blank_split(letters_and_digits(F.col("t")))).alias("words"))
    hits = words.select("doc_id", "h", rolling("words", k).alias("gs")).select("doc_id", "h", F.posexplode("gs").alias("pos", "g"))
    start = F.greatest(F.lit(0), F.col("pos") - F.col("ipos")).alias("start")
    spots = hits.join(mark(grams), "g").groupBy("doc_id", "h").agg(
        F.collect_set(F.struct("n_words", start)).alias("spots"), F.collect_set(F.struct("g", "w")).alias("known")
    )
    spots = stage(spots, "leak-spots")

    # the documents met, once more, for the shingles of their windows; their narrow keys go ahead, so that only they are shuffled
    def on(side: str) -> Column:
        return F.col("d.doc_id").eqNullSafe(F.col(f"{side}.doc_id")) & (F.xxhash64("d.t") == F.col(f"{side}.h"))

    few = base.alias("d").join(small_side(spots.select("doc_id", "h")).alias("m"), on("m"), "left_semi")
    met = few.alias("d").join(spots.alias("s"), on("s")).select("d.doc_id", "s.h", "s.spots", "s.known", once(blank_split(letters_and_digits(F.col("d.t")))).alias("words"))
    met = met.select("doc_id", "h", "spots", "known", once(rolling("words", k)).alias("gs"))

    def window(x: Column) -> Column:
        return F.struct(x["n_words"].alias("n_words"), x["start"].alias("start"), F.array_distinct(F.slice("gs", x["start"] + 1, x["n_words"] - (k - 1))).alias("win"))

    cut = met.select("doc_id", "h", "known", F.explode(F.transform("spots", window)).alias("x")).select("doc_id", "h", "known", "x.*").filter(F.size("win") > 0)
    windows = cut.select(
        "doc_id", "h", "n_words", "start", "win", once(simhash(F.col("win"))).alias("fp"),
        # what no item holds weighs 1
        (F.size("win") + F.aggregate(F.filter("known", lambda x: F.array_contains("win", x["g"])), F.lit(0.0), lambda s, x: s + x["w"] - 1)).alias("win_w"),
    )
    windows = stage(windows, "leak-windows")

    # multi-index: windows and items of one length meet where one block is equal
    left = windows.withColumn("block", F.explode(blocks(F.col("fp"), radius)))
    right = table.select("item_key", "item_id", "n_words", "own", F.col("fp").alias("item_fp")).withColumn("block", F.explode(blocks(F.col("item_fp"), radius)))
    near = left.join(right, ["n_words", "block"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).filter(F.col("hamming") <= radius)
    near = near.dropDuplicates(["doc_id", "h", "item_key", "start"])
    shared = F.aggregate(F.filter("own", lambda x: F.array_contains(F.col("win"), x["g"])), F.lit(0.0), lambda s, x: s + x["w"])
    total = F.aggregate("own", F.lit(0.0), lambda s, x: s + x["w"])
    n_shared = F.size(F.array_intersect(F.col("own.g"), F.col("win")))
    near = near.withColumns({"shared": shared, "total": total, "n": n_shared})
    plain = F.col("n") / (F.size("own") + F.size("win") - F.col("n"))
    near = near.withColumn("similarity", F.greatest(F.col("shared") / (F.col("total") + F.col("win_w") - F.col("shared")), plain)).filter(F.col("similarity") >= min_similarity - 1e-9)
    best = near.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words", "hamming")).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.start").alias("start_word"), F.col("x.n_words").alias("n_words"), F.col("x.hamming").alias("hamming"), F.round(-F.col("x.s"), 9).alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns stay. Rows with a null key are judged like others."""
    found = small_side(stage(matches(docs, items, key=key, **options).select(F.col("doc_id").alias("leaked_id")).distinct(), "leak-found"))
    return docs.join(found, docs[key].eqNullSafe(found["leaked_id"]), "left_anti")
