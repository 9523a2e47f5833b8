"""Candidate pairs between two terminologies: DataFrames of (concept_id, term) or (concept_id, ref)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.functions.text import norm_key, tokens
from lodestitch.functions.tokens import TokenNormalizer

_REFS_A_TASK = 500_000


def _pairs(df: DataFrame, method: str) -> DataFrame:
    return df.select("hpo_id", "sct_id", F.lit(method).alias("attribute"), F.col("confidence").cast("double").alias("confidence"))


def exact_lexical(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs with an equal term after trimming and lower-casing; blank terms never match."""
    s = source.select(F.col("concept_id").alias("hpo_id"), norm_key("term").alias("k")).filter("k != ''").distinct()
    t = target.select(F.col("concept_id").alias("sct_id"), norm_key("term").alias("k")).filter("k != ''").distinct()
    return _pairs(s.join(t, "k").select("hpo_id", "sct_id").distinct().withColumn("confidence", F.lit(1.0)), "exact_lexical")


def jaccard(source: DataFrame, target: DataFrame, threshold: float = 0.90, normalizer: TokenNormalizer | None = None) -> DataFrame:
    """Pairs whose token sets have a Jaccard similarity over ``threshold``; the best of a pair counts.

    Tokens are cut at blanks, or made by ``normalizer``; a term without tokens matches nothing. Distinct token sets
    stand for their terms. Tokens are ordered rarest first and a set is met only through its prefix, which any
    partner over the threshold shares, and only by sets of a size that can reach the threshold: sizes fall into
    bands, one of which is as wide as that ratio, so partners lie in the same band or the next, and a frequent token
    is parted by band.
    """

    def sets(df: DataFrame, name: str) -> DataFrame:
        if normalizer is None:
            df = df.select("concept_id", tokens("term").alias("tokens"))
        else:
            df = normalizer.normalize(df.select("concept_id", "term"))
        return df.select(F.col("concept_id").alias(name), F.sort_array(F.array_distinct("tokens")).alias("ts")).filter(F.size("ts") > 0).distinct()

    s, t = sets(source, "hpo_id"), sets(target, "sct_id")
    every = s.select("ts").distinct().unionByName(t.select("ts").distinct()).distinct()
    df = every.select(F.explode("ts").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = every.select("ts", F.explode("ts").alias("w")).join(df, "w").groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("o"))
    keep = F.size("ts") - F.ceil(F.size("ts") * F.lit(threshold) - 1e-9).cast("int") + 1
    band = F.floor(F.ln(F.size("ts")) / -math.log(threshold) + 1e-9).cast("int")
    prefix = ranked.select("ts", band.alias("band"), F.explode(F.slice(F.col("o.w"), 1, keep)).alias("w"))
    near_bands = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band")
    a = prefix.join(s.select("ts").distinct(), "ts", "left_semi").select(F.col("ts").alias("a"), "w", near_bands)
    b = prefix.join(t.select("ts").distinct(), "ts", "left_semi").withColumnRenamed("ts", "b")
    fits = F.least(F.size("a"), F.size("b")) >= F.greatest(F.size("a"), F.size("b")) * F.lit(threshold)
    near = a.join(b, ["w", "band"]).filter(fits).select("a", "b").distinct()
    i = F.size(F.array_intersect("a", "b"))
    near = near.withColumn("confidence", i / (F.size("a") + F.size("b") - i)).filter(F.col("confidence") > threshold)
    met = near.join(s.withColumnRenamed("ts", "a"), "a").join(t.withColumnRenamed("ts", "b"), "b")
    return _pairs(met.groupBy("hpo_id", "sct_id").agg(F.max("confidence").alias("confidence")), "jaccard")


def xref_direct(refs: DataFrame, loaded: DataFrame) -> DataFrame:
    """References of source concepts to target concepts that are loaded.

    Nearly every reference differs, so they are dealt before they are made distinct, to as many tasks as their number asks for.
    """
    parts = max(1, -(-refs.count() // _REFS_A_TASK))
    ok = refs.select("concept_id", "ref").repartition(parts, "concept_id", "ref").distinct().join(loaded.select(F.col("concept_id").alias("ref")).distinct(), "ref", "left_semi")
    return _pairs(ok.select(F.col("concept_id").alias("hpo_id"), F.col("ref").alias("sct_id"), F.lit(1.0).alias("confidence")), "hpo_sct")


def xref_bridge(refs: DataFrame, bridge: DataFrame) -> DataFrame:
    """Two hops: a source concept refers to a bridge concept, which refers to a target concept."""
    hop = refs.select("concept_id", F.col("ref").alias("mid")).distinct().join(bridge.select(F.col("concept_id").alias("mid"), "ref").distinct(), "mid")
    return _pairs(hop.select(F.col("concept_id").alias("hpo_id"), F.col("ref").alias("sct_id"), F.lit(1.0).alias("confidence")).distinct(), "hpo_umls_sct")


def xref_shared(source_side: DataFrame, target_side: DataFrame) -> DataFrame:
    """A bridge concept (concept_id) lists a source concept on one side and a target concept on the other."""
    a = source_side.select("concept_id", F.col("ref").alias("hpo_id")).distinct()
    b = target_side.select("concept_id", F.col("ref").alias("sct_id")).distinct()
    return _pairs(a.join(b, "concept_id").select("hpo_id", "sct_id", F.lit(1.0).alias("confidence")).distinct(), "umls_hpo_sct")
