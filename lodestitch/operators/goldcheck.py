"""The review's prompts and strict reading of answers, put to the pairs of the gold standard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.constants import ACCEPTED, REVIEW_REASON

from . import distances, review
from .evaluation import PAIR

_REVIEWED = ["n_sct", "llm_pass", "llm_decision", "confidence", "llm_rationale"]


def check(gold: DataFrame, source: DataFrame, target: DataFrame, target_edges: DataFrame, model: Callable[[list[str]], list[str]], settings: str, store: str | None = None, source_edges: DataFrame | None = None) -> DataFrame:
    """(hpo_id, hpo_label, sct_id, sct_label, status, n_sct, llm_pass, llm_decision, confidence, llm_rationale), one row a gold pair.

    ``source`` and ``target`` are (concept_id, attribute, value). A pair is checked if both its concepts have a label;
    others keep null review columns. Concepts with one checked target are asked by pair, others as a group; an answer
    without a valid decision for a target rejects it with the lowest confidence. Related targets in a prompt come
    from a climb above the checked targets only. Labels are joined by "; ", empty where there is none.
    """
    known = [x.filter("attribute = 'label' AND value IS NOT NULL") for x in (source, target)]
    pairs = review.gold_status(gold, *known)
    checked = pairs.filter("status = 'CHECKED'").select(*PAIR)
    n = checked.groupBy("hpo_id").agg(F.count(F.lit(1)).alias("n_sct"))
    chosen = checked.join(n, "hpo_id").select(*PAIR, F.lit(ACCEPTED).alias("validity"), F.lit(REVIEW_REASON[ACCEPTED]).alias("review_reason"), "n_sct", F.when(F.col("n_sct") == 1, 1).otherwise(2).alias("llm_pass"))
    above = distances.climb(checked.select("sct_id"), target_edges).filter("steps > 0").select(F.col("node").alias("ancestor"), F.col("start").alias("descendant"), F.col("steps").alias("min_steps"))
    none = target_edges.limit(0)
    asked = review.prompts(chosen, review.describe(source, none if source_edges is None else source_edges), review.describe(target, target_edges), above)
    answers = review.generate(asked, model, settings, store)
    one = review.parse_pair(chosen.filter("llm_pass = 1").join(answers.filter("llm_pass = 1").select("hpo_id", "answer"), "hpo_id", "left"))
    many = review.parse_group(chosen.filter("llm_pass = 2"), answers.filter("llm_pass = 2").select("hpo_id", "answer"))
    said = one.select(*PAIR, *_REVIEWED).unionByName(many.select(*PAIR, *_REVIEWED))
    out = pairs.join(said, PAIR, "left")
    for c, name, labels in (("hpo_id", "hpo_label", known[0]), ("sct_id", "sct_label", known[1])):
        every = labels.groupBy(F.col("concept_id").alias(c)).agg(F.array_join(F.array_sort(F.collect_list("value")), "; ").alias(name))
        out = out.join(every, c, "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out.select("hpo_id", "hpo_label", "sct_id", "sct_label", "status", *_REVIEWED)
