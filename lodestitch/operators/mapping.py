"""Aggregations and rankings over mapping rows (hpo_id, sct_id, attribute, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ("hpo_id", "sct_id")


def dedupe_max(rows: DataFrame) -> DataFrame:
    """One row per pair with its highest confidence."""
    return rows.groupBy(*PAIR).agg(F.max("confidence").alias("confidence"))


def pair_methods(rows: DataFrame) -> DataFrame:
    """Sorted, comma-joined methods and their number per pair."""
    return rows.groupBy(*PAIR).agg(F.sort_array(F.collect_set("attribute")).alias("m"), F.max("confidence").alias("best_conf")).select(
        *PAIR, F.array_join("m", ",").alias("methods"), F.size("m").cast("long").alias("n_methods"), "best_conf"
    )


def best_per_concept(rows: DataFrame) -> DataFrame:
    """The best pair of each source concept; ties go to the smaller target id."""
    w = Window.partitionBy("hpo_id").orderBy(F.desc("confidence"), "sct_id")
    return dedupe_max(rows).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def constellations(rows: DataFrame) -> DataFrame:
    """Numbers of pairs by cardinality of their two concepts."""
    p = rows.select(*PAIR).distinct()
    a = p.groupBy("hpo_id").agg(F.count(F.lit(1)).alias("n_sct"))
    b = p.groupBy("sct_id").agg(F.count(F.lit(1)).alias("n_hpo"))
    kind = F.concat(F.when(F.col("n_hpo") == 1, "1").otherwise("m"), F.lit(":"), F.when(F.col("n_sct") == 1, "1").otherwise("n"))
    kind = F.when(kind == "m:1", "n:1").otherwise(kind)
    return p.join(a, "hpo_id").join(b, "sct_id").groupBy(kind.alias("constellation")).agg(F.count(F.lit(1)).alias("n_pairs"))


def metrics(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """n_predicted, n_gold, n_correct, precision, recall and f1 of distinct pairs; 0 on empty denominators."""
    p, g = predicted.select(*PAIR).distinct().withColumn("p", F.lit(1)), gold.select(*PAIR).distinct().withColumn("g", F.lit(1))
    n = p.join(g, [*PAIR], "full").agg(F.count("p").alias("n_predicted"), F.count("g").alias("n_gold"), F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("n_correct"))

    def share(a: str, b: str):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    n = n.withColumn("precision", share("n_correct", "n_predicted")).withColumn("recall", share("n_correct", "n_gold"))
    return n.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
