"""Stage, review and error reports over the table of pairs that ``evaluation.pair_info`` makes.

``info`` has one row per generated pair with original_validity, auto_accepted, llm_accepted and in_gold;
a pair is final if the rules or the review accepted it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestitch.constants import ACCEPTED, EXAMPLES_SHOWN, REJECTS_SHOWN, REVIEW_REASON, STAGES
from lodestitch.functions.text import semantic_tag, share

from .evaluation import PAIR, _one, method_combinations

FINAL = "auto_accepted OR llm_accepted"


def union_methods(*found: DataFrame) -> DataFrame:
    """All rows of the generators, in their order: ``method_order`` counts from 0. A pair stays once per method."""
    out = None
    for i, df in enumerate(found):
        part = df.select(*PAIR, "attribute", "confidence", F.lit(i).cast("long").alias("method_order"))
        out = part if out is None else out.unionByName(part)
    return out


def explode_lookup(lookup: DataFrame, method: str) -> DataFrame:
    """(hpo_id, sct_id, attribute), one row for each value of ``lookup`` (id, values)."""
    return lookup.select(F.col("id").alias("hpo_id"), F.explode("values").alias("sct_id"), F.lit(method).alias("attribute"))


def keep_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose pair is one of ``pairs``."""
    return rows.join(pairs.select(*PAIR).distinct(), PAIR, "left_semi")


def final_pairs(info: DataFrame) -> DataFrame:
    return info.filter(FINAL).select(*PAIR)


def invalid_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: n_references, n_invalid (their ``ref`` is no concept of ``targets``) and n_concepts that have an invalid one."""
    known = targets.select(F.col("concept_id").alias("ref"), F.lit(True).alias("known")).distinct()
    bad = F.col("known").isNull()
    return refs.join(known, "ref", "left").agg(F.count(F.lit(1)).alias("n_references"), _one(bad).alias("n_invalid"), F.countDistinct(F.when(bad, F.col("concept_id"))).alias("n_concepts"))


def edge_asymmetry(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Edges (concept_id, ref) in both directions, or in one only: (kind, n_edges, n_concepts)."""
    sides = forward.select("concept_id", "ref", F.lit(1).alias("side")).unionByName(backward.select("concept_id", "ref", F.lit(2).alias("side")))
    kind = F.element_at(F.array(*map(F.lit, ("forward", "backward", "both"))), F.bit_or("side"))
    met = sides.groupBy("concept_id", "ref").agg(kind.alias("kind"))
    return met.groupBy("kind").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("concept_id").alias("n_concepts"))


def anchor_domains(accepted: DataFrame, labels: DataFrame) -> DataFrame:
    """Accepted pairs by the first non-empty tag among the target's labels (concept_id, ord, value), else ``unknown``."""
    tags = labels.select(F.col("concept_id").alias("sct_id"), "ord", semantic_tag("value").alias("domain")).filter("domain != ''")
    first = tags.groupBy("sct_id").agg(F.min_by("domain", "ord").alias("domain"))
    p = accepted.select(*PAIR).distinct().join(first, "sct_id", "left")
    return p.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count(F.lit(1)).alias("n_pairs"))


def tied_concepts(rows: DataFrame) -> DataFrame:
    """One row: the concepts, and those of them with more than one target of highest confidence."""
    best = rows.groupBy(*PAIR).agg(F.max("confidence").alias("c"))
    tied = best.groupBy("hpo_id", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("hpo_id").agg(F.max_by("n", "c").alias("n"))
    return tied.agg(F.count(F.lit(1)).alias("n_hpo"), _one(F.col("n") > 1).alias("n_tied"))


def _scores(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of n_pairs, n_correct and n_gold."""
    df = df.withColumn("precision", share(F.col("n_correct"), F.col("n_pairs"))).withColumn("recall", share(F.col("n_correct"), F.col("n_gold")))
    return df.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _n_gold(gold: DataFrame) -> DataFrame:
    return gold.select(*PAIR).distinct().agg(F.count(F.lit(1)).alias("n_gold"))


def _spine(df: DataFrame, name: str, values: list, kind: str) -> DataFrame:
    """``df`` with a row for each of a few ``values``; counts of absent ones are 0."""
    out = df.sparkSession.createDataFrame([(v,) for v in values], f"{name} {kind}").join(df, name, "left")
    return out.na.fill(0, [c for c in df.columns if c != name])


def stage_comparison(info: DataFrame, gold: DataFrame) -> DataFrame:
    """n_pairs, n_correct, precision, recall, F1 and the share of correct pairs among all generated, for five sets of pairs in one pass."""
    held = (F.lit(True), F.col("original_validity").between(1, ACCEPTED), F.col("auto_accepted"), F.col("llm_accepted"), F.expr(FINAL))
    stages = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in zip(STAGES, held, strict=True)]))
    n = info.select("in_gold", F.explode(stages).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n_pairs"), _one(F.col("in_gold")).alias("n_correct"))
    every = info.agg(F.count(F.lit(1)).alias("n_all"))
    out = _spine(n, "stage", list(STAGES), "string").join(F.broadcast(_n_gold(gold))).join(F.broadcast(every))
    return _scores(out).withColumn("universe_share", share(F.col("n_correct"), F.col("n_all"))).drop("n_all")


def review_reasons(info: DataFrame, gold: DataFrame) -> DataFrame:
    """Per code of review: pairs, accepted ones, their share, and how the accepted ones score against the gold standard."""
    yes = F.col("llm_accepted")
    n = info.filter(F.col("original_validity").isin(*REVIEW_REASON)).groupBy(F.col("original_validity").cast("long").alias("validity"))
    n = n.agg(F.count(F.lit(1)).alias("n_reviewed"), _one(yes).alias("n_pairs"), _one(yes & F.col("in_gold")).alias("n_correct"))
    out = _scores(_spine(n, "validity", sorted(REVIEW_REASON), "long").join(F.broadcast(_n_gold(gold))))
    reason = F.create_map(*[F.lit(x) for c, r in REVIEW_REASON.items() for x in (c, r)])
    out = out.withColumn("reason", F.element_at(reason, F.col("validity").cast("int"))).withColumn("accepted_share", share(F.col("n_pairs"), F.col("n_reviewed")))
    return out.withColumnRenamed("n_pairs", "n_accepted")


def review_evaluations(info: DataFrame, passes: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores before the review, of what each pass and the whole review accepted, and of the final set.

    ``passes`` is (hpo_id, sct_id, llm_pass); the sets are counted in one pass over the pairs.
    """
    p = info.join(passes.select(*PAIR, "llm_pass").distinct(), PAIR, "left")
    yes = F.col("llm_accepted")
    held = {"before": F.col("auto_accepted"), "pass 1": yes & (F.col("llm_pass") == 1), "pass 2": yes & (F.col("llm_pass") == 2), "llm": yes, "final": F.expr(FINAL)}
    sets = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in held.items()]))
    n = p.select("hpo_id", "in_gold", F.explode(sets).alias("stage")).groupBy("stage")
    n = n.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("hpo_id").alias("n_hpo"), _one(F.col("in_gold")).alias("n_correct"))
    return _scores(_spine(n, "stage", list(held), "string").join(F.broadcast(_n_gold(gold))))


def reversal_quality(info: DataFrame) -> DataFrame:
    """One row on the hierarchy reversals (codes 1 to 7): pairs, correct ones, both again for what the review accepted, and lost gold pairs."""
    yes, ok = F.col("llm_accepted"), F.col("in_gold")
    return info.filter(F.col("original_validity").between(1, 7)).agg(
        F.count(F.lit(1)).alias("n_pairs"), _one(ok).alias("n_correct"), _one(yes).alias("n_accepted"), _one(yes & ok).alias("accepted_correct"), _one(~yes & ok).alias("n_lost_gold")
    )


def lost_gold(info: DataFrame) -> DataFrame:
    """The gold pairs among the hierarchy reversals that the review didn't bring back."""
    return info.filter(F.col("original_validity").between(1, 7) & ~F.col("llm_accepted") & F.col("in_gold")).select(*PAIR, "original_validity")


def review_false_positives(info: DataFrame) -> DataFrame:
    """Pairs the review accepted that aren't gold pairs."""
    return info.filter("llm_accepted AND NOT in_gold").select(*PAIR, "original_validity")


def error_categories(info: DataFrame, gold: DataFrame) -> DataFrame:
    """(hpo_id, category, correct, missing, extra) of every concept whose final targets aren't its gold targets.

    A: gold, but no pair generated. B: pairs, but none final. C: a final pair, no gold. D_WRONG: no final target is
    a gold target. D_PARTIAL: some gold targets are missing. The lists are sorted, comma-joined target ids.
    """
    made = info.select(*PAIR, F.expr(FINAL).alias("fin"))
    every = made.join(gold.select(*PAIR).distinct().withColumn("g", F.lit(True)), PAIR, "full")
    fin, g = F.coalesce("fin", F.lit(False)), F.coalesce("g", F.lit(False))

    def ids(cond: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("sct_id").cast("string")))), ",")

    by = every.groupBy("hpo_id").agg(
        F.count("fin").alias("n_made"), _one(fin).alias("n_fin"), _one(g).alias("n_gold"), _one(fin & g).alias("both"),
        ids(fin & g).alias("correct"), ids(~fin & g).alias("missing"), ids(fin & ~g).alias("extra"),
    )
    kind = F.when(F.col("n_gold") == 0, F.when(F.col("n_fin") > 0, "C")).when(F.col("n_made") == 0, "A").when(F.col("n_fin") == 0, "B")
    kind = kind.when(F.col("both") == 0, "D_WRONG").when(F.col("both") < F.col("n_gold"), "D_PARTIAL")
    return by.withColumn("category", kind).filter("category IS NOT NULL").select("hpo_id", "category", "correct", "missing", "extra")


def most_targets(info: DataFrame, n: int = EXAMPLES_SHOWN) -> DataFrame:
    """The ``n`` concepts with the most final targets, of those with several; ties by id."""
    by = info.filter(FINAL).groupBy("hpo_id").agg(F.count(F.lit(1)).alias("n_targets"), _one(F.col("in_gold")).alias("n_correct"))
    return by.filter("n_targets > 1").orderBy(F.desc("n_targets"), "hpo_id").limit(n)


def examples(pairs: DataFrame, n: int = EXAMPLES_SHOWN) -> DataFrame:
    """The first ``n`` distinct pairs by id, each with ``n_more``, how many are left out."""
    p = pairs.select(*PAIR).distinct()
    more = p.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("n_more"))
    return p.orderBy(*PAIR).limit(n).join(F.broadcast(more))


def top_combinations(rows: DataFrame, gold: DataFrame, n: int = EXAMPLES_SHOWN) -> DataFrame:
    """The ``n`` sets of methods with the most correct pairs, then pairs; ties by name."""
    return method_combinations(rows, gold).orderBy(F.desc("n_correct"), F.desc("n_pairs"), "methods").limit(n)


def top_rejects(checked: DataFrame, n: int = REJECTS_SHOWN) -> DataFrame:
    """The ``n`` rejected gold pairs with the highest confidence; ties by id."""
    return checked.filter("status = 'CHECKED' AND llm_decision = 'REJECT'").orderBy(F.desc("confidence"), *PAIR).limit(n)


def near_miss(near: DataFrame, gold: DataFrame) -> DataFrame:
    """One row on the pairs (``evaluation.nearest_target``) of gold concepts: shares at distance 0, up to 1 and up to 2 of a gold target."""
    p = near.join(gold.select("hpo_id").distinct(), "hpo_id", "left_semi")
    n = F.count(F.lit(1))
    return p.agg(n.alias("n_pairs"), *(share(_one(F.col("gold_distance") <= k), n).alias(f"within_{k}") for k in (0, 1, 2)))


def unusable_reasons(answers: DataFrame) -> DataFrame:
    """(reason, n) of the answers marked ``unusable``; ``skipped`` and ``truncated`` tell how the model's run ended."""
    reason = F.when(F.col("skipped"), "SKIPPED").when(F.col("truncated"), "TRUNCATED").otherwise("INVALID")
    return answers.filter("unusable").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def audit(reviewed: DataFrame) -> DataFrame:
    """One row per reviewed pair in the columns of the review's file."""
    return reviewed.select(*PAIR, "validity", "n_sct", "llm_pass", "llm_decision", "confidence", "llm_rationale")


def labelled(pairs: DataFrame, source_labels: DataFrame, target_labels: DataFrame) -> DataFrame:
    """``pairs`` with hpo_label and sct_label: a concept's labels (concept_id, ord, value) joined by "; ", or its id if it has none."""
    for c, name, labels in (("hpo_id", "hpo_label", source_labels), ("sct_id", "sct_label", target_labels)):
        every = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])
        one = labels.filter("value IS NOT NULL").groupBy(F.col("concept_id").alias(c)).agg(F.array_join(every, "; ").alias(name))
        pairs = pairs.join(one, c, "left").withColumn(name, F.coalesce(name, F.col(c).cast("string")))
    return pairs
