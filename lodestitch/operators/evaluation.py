"""Evaluation tables over pairs, mapping rows and a gold standard; every table is a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestitch.constants import METHODS, REPORT_THRESHOLDS, SWEEP_POINTS
from lodestitch.functions.text import outcome, share

PAIR = ["hpo_id", "sct_id"]


def _flag(pairs: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """``pairs`` with a membership column."""
    return pairs.join(others.select(*PAIR).distinct().withColumn(name, F.lit(True)), PAIR, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _one(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0)).cast("long")


def threshold_counts(rows: DataFrame, gold: DataFrame, thresholds: tuple[float, ...] = REPORT_THRESHOLDS) -> DataFrame:
    """Per threshold: pairs and correct pairs at or above it, and in its half-open bucket below the one before.

    A pair is put into its bucket once; the cumulated counts are a running sum over the few buckets.
    """
    steps = sorted(set(thresholds), reverse=True)
    bucket = F.coalesce(*[F.when(F.col("confidence") >= t, F.lit(float(t))) for t in steps])
    best = rows.groupBy(*PAIR).agg(F.max("confidence").alias("confidence"))
    got = _flag(best, gold, "ok").withColumn("threshold", bucket).filter("threshold IS NOT NULL").groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), _one(F.col("ok")).alias("k"))
    spine = rows.sparkSession.createDataFrame([(float(t),) for t in steps], "threshold double")
    got = spine.join(got, "threshold", "left").na.fill(0, ["n", "k"])
    w = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    out = got.select("threshold", F.col("n").alias("n_bucket"), F.col("k").alias("correct_bucket"), F.sum("n").over(w).alias("n_pairs"), F.sum("k").over(w).alias("n_correct"))
    return out.withColumn("precision", share(F.col("n_correct"), F.col("n_pairs")))


def pr_curve(rows: DataFrame, gold: DataFrame, low: float, high: float = 1.0, points: int = SWEEP_POINTS) -> DataFrame:
    """Precision, recall and F1 at evenly spaced thresholds from ``low`` to ``high``."""
    n_gold = gold.select(*PAIR).distinct().agg(F.count(F.lit(1)).alias("n_gold"))
    steps = tuple(low + (high - low) * i / (points - 1) for i in range(points))
    out = threshold_counts(rows, gold, steps).select("threshold", "n_pairs", "n_correct", "precision").join(F.broadcast(n_gold))
    out = out.withColumn("recall", share(F.col("n_correct"), F.col("n_gold"))).drop("n_gold")
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def evaluation(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """n_pairs, n_correct, n_hpo, gold_hpo_hit, hpo_not_in_gold, precision and recall of distinct pairs."""
    p = _flag(pairs.select(*PAIR).distinct(), gold, "ok")
    ids = gold.select("hpo_id").distinct().withColumn("known", F.lit(True))
    n_gold = gold.select(*PAIR).distinct().agg(F.count(F.lit(1)).alias("n_gold"))
    out = p.join(ids, "hpo_id", "left").agg(
        F.count(F.lit(1)).alias("n_pairs"), _one(F.col("ok")).alias("n_correct"), F.countDistinct("hpo_id").alias("n_hpo"),
        F.countDistinct(F.when(F.col("ok"), F.col("hpo_id"))).alias("gold_hpo_hit"), F.countDistinct(F.when(F.col("known").isNull(), F.col("hpo_id"))).alias("hpo_not_in_gold"),
    ).join(F.broadcast(n_gold))
    return out.withColumn("precision", share(F.col("n_correct"), F.col("n_pairs"))).withColumn("recall", share(F.col("n_correct"), F.col("n_gold")))


def _methods(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*PAIR).agg(F.sort_array(F.collect_set("attribute")).alias("ms"))


def method_table(rows: DataFrame, gold: DataFrame, order: tuple[str, ...] = METHODS) -> DataFrame:
    """Per method: pairs, correct ones, pairs no earlier method of ``order`` found, their running sum, unique correct ones."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("m"))
    p = _flag(_methods(rows), gold, "ok")
    p = p.withColumn("first", F.array_min(F.transform("ms", lambda m: F.array_position(F.array(*map(F.lit, order)), m))))
    e = p.select("ok", "first", F.size("ms").alias("n"), F.explode("ms").alias("m")).withColumn("at", at)
    out = e.groupBy("m", "at").agg(F.count(F.lit(1)).alias("n_pairs"), _one(F.col("ok")).alias("n_correct"), _one(F.col("first") == F.col("at")).alias("n_new"), _one(F.col("ok") & (F.col("n") == 1)).alias("unique_correct"))
    w = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return out.select(F.col("m").alias("attribute"), "n_pairs", "n_correct", "n_new", F.sum("n_new").over(w).alias("n_cumulative"), "unique_correct")


def method_combinations(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairs and precision by the exact set of methods."""
    p = _flag(_methods(rows), gold, "ok").groupBy(F.array_join("ms", ",").alias("methods")).agg(F.count(F.lit(1)).alias("n_pairs"), _one(F.col("ok")).alias("n_correct"))
    return p.withColumn("precision", share(F.col("n_correct"), F.col("n_pairs")))


def pairwise_overlap(rows: DataFrame) -> DataFrame:
    """Pairs shared by each two methods."""
    m = _methods(rows).select(F.explode("ms").alias("m1"), "ms").select("m1", F.explode("ms").alias("m2")).filter("m1 < m2")
    return m.groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("n_pairs"))


def agreement(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairs and correct ones found by exactly and by at least k methods."""
    k = _flag(_methods(rows), gold, "ok").groupBy(F.size("ms").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("exactly"), _one(F.col("ok")).alias("exactly_correct"))
    w = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return k.select("k", "exactly", "exactly_correct", F.sum("exactly").over(w).alias("at_least"), F.sum("exactly_correct").over(w).alias("at_least_correct"))


def code_counts(coded: DataFrame) -> DataFrame:
    """Rows, pairs and concepts per validity code, null included."""
    return coded.groupBy("validity").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.struct(*PAIR)).alias("n_pairs"), F.countDistinct("hpo_id").alias("n_hpo"))


def step_outcomes(coded: DataFrame) -> DataFrame:
    """Distinct pairs of each step by outcome."""
    p = coded.filter("step IS NOT NULL").select(*PAIR, "step", outcome(F.col("validity")).alias("o")).distinct()
    return p.groupBy("step").agg(*(_one(F.col("o") == x).alias(x) for x in ("accepted", "conflict", "review", "removed")))


def coverage(generated: DataFrame, final: DataFrame, gold: DataFrame) -> DataFrame:
    """Per gold concept group: how many have a generated and how many a final pair."""
    g = gold.select("hpo_id").distinct()
    for name, df in (("gen", generated), ("fin", final)):
        g = g.join(df.select("hpo_id").distinct().withColumn(name, F.lit(1)), "hpo_id", "left")
    return g.agg(F.count(F.lit(1)).alias("n_gold_hpo"), F.count("gen").alias("n_generated"), F.count("fin").alias("n_final"))


def any_all_exact(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold concepts of which any, all and exactly the gold targets are found; from counts, no target list is built."""
    p, g = pairs.select(*PAIR).distinct().withColumn("p", F.lit(1)), gold.select(*PAIR).distinct().withColumn("g", F.lit(1))
    by = p.join(g, PAIR, "full").groupBy("hpo_id").agg(F.count("p").alias("n_p"), F.count("g").alias("n_g"), F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("both")).filter("n_g > 0")
    return by.agg(F.count(F.lit(1)).alias("n_hpo"), _one(F.col("both") > 0).alias("n_any"), _one(F.col("both") == F.col("n_g")).alias("n_all"), _one((F.col("both") == F.col("n_g")) & (F.col("both") == F.col("n_p"))).alias("n_exact"))


def diagnose(coded: DataFrame, final: DataFrame, gold: DataFrame) -> DataFrame:
    """Why gold pairs are missing from ``final``: (reason, n_pairs)."""
    code = coded.groupBy(*PAIR).agg(F.max("validity").alias("v"), F.lit(True).alias("made"))
    missed = gold.select(*PAIR).distinct().join(final.select(*PAIR).distinct(), PAIR, "left_anti").join(code, PAIR, "left")
    v = F.col("v")
    reason = F.when(F.col("made").isNull(), "NEVER_GENERATED").when(v.isNull(), "NOT_REACHED").when(v == 0, "DOMAIN_REJECTED").when(v.between(1, 7), "HIERARCHY_REVERSAL_LLM_REJECTED").when(v.isin(8, 9), "FALLBACK_LLM_REJECTED").otherwise("INCONSISTENCY")
    return missed.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_pairs"))


def nearest_target(pairs: DataFrame, gold: DataFrame, distances: DataFrame) -> DataFrame:
    """(hpo_id, sct_id, gold_distance, nearest_gold_sct): the nearest gold target of the concept; ties go to the smaller id.

    ``distances`` is (a, b, distance) over pair target and gold target.
    """
    p = pairs.select(*PAIR).distinct()
    g = gold.select("hpo_id", F.col("sct_id").alias("g")).distinct()
    met = p.join(g, "hpo_id").join(distances.select(F.col("a").alias("sct_id"), F.col("b").alias("g"), "distance"), ["sct_id", "g"], "left").filter("distance IS NOT NULL")
    near = met.groupBy(*PAIR).agg(F.min(F.struct("distance", "g")).alias("m")).select(*PAIR, F.col("m.distance").alias("gold_distance"), F.col("m.g").alias("nearest_gold_sct"))
    return p.join(near, PAIR, "left")


def pipeline_flow(coded: DataFrame, final: DataFrame) -> DataFrame:
    """(source, target, n_pairs): links from step to outcome and from outcome to final or rejected."""
    p = _flag(coded.groupBy(*PAIR).agg(F.max("validity").alias("v"), F.max("step").alias("step")), final, "fin")
    p = p.withColumn("o", F.coalesce(outcome(F.col("v")), F.lit("unreached"))).withColumn("s", F.concat(F.lit("step "), F.coalesce("step", F.lit("none"))))
    end = F.when(F.col("fin"), "final").otherwise("rejected")
    links = p.select(F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("o").alias("target")), F.struct(F.col("o").alias("source"), end.alias("target")))).alias("l"))
    return links.groupBy("l.source", "l.target").agg(F.count(F.lit(1)).alias("n_pairs"))


def pair_info(coded: DataFrame, gold: DataFrame, accepted_llm: DataFrame) -> DataFrame:
    """One row per pair: in_gold, auto_accepted, llm_accepted, original_validity, methods, best_conf."""
    p = coded.groupBy(*PAIR).agg(F.max("validity").alias("original_validity"), F.array_join(F.sort_array(F.collect_set("attribute")), ",").alias("methods"), F.max("confidence").alias("best_conf"))
    p = p.withColumn("auto_accepted", F.coalesce(F.col("original_validity") == 10, F.lit(False)))
    return _flag(_flag(p, gold, "in_gold"), accepted_llm, "llm_accepted")


def accepted_without_gold(info: DataFrame, gold: DataFrame) -> DataFrame:
    """Accepted pairs whose concept has no gold pair at all."""
    return info.filter("auto_accepted OR llm_accepted").join(gold.select("hpo_id").distinct(), "hpo_id", "left_anti")


def disagreements(info: DataFrame) -> DataFrame:
    """Pairs that only the rules or only the review accepted."""
    kind = F.when(F.col("auto_accepted"), "auto_only").otherwise("llm_only")
    return info.filter("auto_accepted != llm_accepted").select(*PAIR, kind.alias("disagreement"), "in_gold", "original_validity")
