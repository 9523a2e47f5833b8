"""Sharding by proportional stratified interleaving.

Rows get a seeded random rank within their source; ``(rank + u) / n`` places them on [0, 1), so any
interval of that line holds every source in proportion. The line is cut into equal numbers of rows.

No rank is taken in one task. Both rankings work on about sqrt(rows) buckets cut from the sort key:
row numbers inside a bucket, plus the running count of the buckets before it. A source with a third of
all rows is spread over all of its buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unit31


def interleave(
    docs: DataFrame,
    n_shards: int = 40,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "source",
) -> DataFrame:
    """Deal ``docs`` into ``n_shards`` shards whose row counts differ by one at most.

    Returns key, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard, stratum and the
    fraction that orders the rows. A null text counts as no bytes, with the checksum of the empty string;
    a null stratum is a stratum of its own. Repeated rows are dealt one by one. An empty table gives no rows.
    Extra columns are ignored.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        F.when(F.col(stratum).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(stratum).cast("string"))).alias("s"),
        (F.octet_length(t).cast("long") + 16).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
    )
    narrow = narrow.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    narrow = stage(narrow, "shard-narrow")
    n = narrow.count()
    buckets = max(1, math.isqrt(max(n, 1)))
    first = narrow.withColumn("b", F.shiftright(unit31(F.col("h")) * buckets, 31))
    before = Window.partitionBy("s").orderBy("b")
    counts = (
        first.groupBy("s", "b").agg(F.count(F.lit(1)).alias("c"))
        .withColumn("before", F.sum("c").over(before) - F.col("c"))
        .withColumn("n_s", F.sum("c").over(Window.partitionBy("s")))
        .drop("c")
    )
    inside = Window.partitionBy("s", "b").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = (
        first.join(counts, ["s", "b"])
        .withColumn("r", F.col("before") + F.row_number().over(inside) - 1)
        .withColumn("u", (unit31(F.xxhash64(F.lit(seed + 1), "s")) + 0.5) / float(1 << 31))
        .withColumn("fraction", (F.col("r") + F.col("u")) / F.col("n_s"))
        .select("doc_id", "s", "size", "text_crc32", "h", "fraction")
    )
    ranked = stage(ranked.withColumn("b", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1))), "shard-ranked")
    counts = (
        ranked.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
        .withColumn("before", F.sum("c").over(Window.orderBy("b")) - F.col("c")).drop("c")
    )
    inside = Window.partitionBy("b").orderBy("fraction", "s", "h", "doc_id", "text_crc32", "size")
    return (
        ranked.join(counts, "b")
        .withColumn("g", F.col("before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"(g * {n_shards}L) div {max(n, 1)}L").cast("int"))
        .withColumn("slot", F.col("g") - F.expr(f"(shard * {max(n, 1)}L + {n_shards - 1}L) div {n_shards}L"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
            F.lit(None).cast("int").alias("grown_shard"),
            F.when(F.col("s").startswith("v"), F.expr("substr(s, 2)")).alias("source"), "fraction",
        )
    )
