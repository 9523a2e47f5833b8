"""All tables of the evaluation from one scan of the pairs, and the structural and distance reports.

Pairs that are alike are added up, then counted under every set they belong to (stage, code, method, step, bucket ...),
and the few sums make up the tables.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestitch.constants import ACCEPTED, DEPTH_BUCKETS, DISTANCE_CAP, FALLBACK_CODES, METHODS, REPORT_THRESHOLDS, REVIEW_REASON, STAGES, STEP_CODE, STEP_LABELS, SWEEP_POINTS, UNMEASURED
from lodestitch.functions.storage import Scratch
from lodestitch.functions.text import domain_ok, outcome, semantic_tag

from . import distances
from .evaluation import PAIR, _flag

#: Pools of similarity rows whose thresholds are reported; the last takes the higher of both.
POOLS = ("jaccard", "embedding", "either")
OUTCOMES = ("accepted", "conflict", "review", "removed")
#: What the fixed sets of a pair depend on; it has few values.
_KIND = ("validity", "step", "methods", "auto", "llm", "final")
#: Sets a long tells apart by its bits.
_WORD = 62
_SCORES = "n_pairs long, n_hpo long, n_correct long, precision double, recall double, f1 double"


def pair_table(rows: DataFrame, gold: DataFrame | Column, accepted: DataFrame | Column) -> DataFrame:
    """One row per pair of any input: made (it was generated), validity, step, methods (bits in the order of generation),
    the best confidence of either similarity method, auto, llm, final, gold, and in_gold for pairs without nulls.

    ``accepted`` are the pairs of the review. It and ``gold`` are tables, or conditions on ``rows``; all meet in one
    aggregation. Nearly every row is a pair of its own, so rows are dealt by pair first instead of being summed up where
    they are read, where a task's memory would grow with the part of a file it reads.
    """
    marks = {"gold": gold, "llm": accepted}
    every = rows.select(*PAIR, "attribute", "confidence", F.col("validity").cast("int").alias("validity"), "step", F.lit(True).alias("made"), *[c.alias(n) for n, c in marks.items() if isinstance(c, Column)])
    for name, others in marks.items():
        if isinstance(others, DataFrame):
            every = every.unionByName(others.select(*PAIR, F.lit(True).alias(name)), allowMissingColumns=True)
    method, flag = F.col("attribute"), {n: F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in ("made", "gold", "llm")}
    bits = F.coalesce(F.bit_or(F.coalesce(*[F.when(method == m, F.lit(1 << i)) for i, m in enumerate(METHODS)])), F.lit(0))
    best = [F.max(F.when(method == m, F.col("confidence"))).alias(m) for m in POOLS[:2]]
    p = every.repartition(*PAIR).groupBy(*PAIR).agg(F.max("validity").alias("validity"), F.max("step").alias("step"), bits.alias("methods"), *best, *flag.values())
    known = F.col("hpo_id").isNotNull() & F.col("sct_id").isNotNull()
    auto, llm = F.coalesce(F.col("validity") == ACCEPTED, F.lit(False)), F.col("llm") & known
    return p.select(*PAIR, "made", "validity", "step", "methods", *POOLS[:2], F.greatest(*POOLS[:2]).alias(POOLS[2]), auto.alias("auto"), llm.alias("llm"), (auto | llm).alias("final"), "gold", (F.col("gold") & known).alias("in_gold"))


class Count(NamedTuple):
    n_pairs: int = 0
    n_hpo: int = 0
    n_correct: int = 0


def _in(table: str, key: Column | str, cond: Column | None = None) -> Column:
    """Membership of a pair in the set ``key`` of ``table``; null where ``cond`` doesn't hold."""
    m = F.struct(F.lit(table).alias("t"), (F.lit(key) if isinstance(key, str) else key).cast("string").alias("k"))
    return m if cond is None else F.when(cond, m)


def _fixed_sets() -> dict[tuple[str, str], Column]:
    """The sets known beforehand, whose concepts are counted too: (table, key) and the condition of a pair."""
    v, o, ms = F.col("validity"), outcome(F.col("validity")), F.col("methods")
    held = zip(STAGES, (F.lit(True), v.between(1, ACCEPTED), F.col("auto"), F.col("llm"), F.col("final")), strict=True)
    out = {("stage", s): c for s, c in held}
    out |= {("code", str(c)): v == c for c in range(ACCEPTED + 1)} | {("code", "none"): v.isNull()}
    fallback = next(i for i, (s, _) in enumerate(STEP_LABELS) if STEP_CODE[s] in FALLBACK_CODES)
    for i, (s, _) in enumerate(STEP_LABELS):
        here = F.col("step") == s
        out |= {("step", s): here} | {("step_outcome", f"{s}>{x}"): here & (o == x) for x in OUTCOMES}
        if i:
            out["step_cumulative", s] = F.col("step").isin(*[x for x, _ in STEP_LABELS[: i + 1]]) & (o == "accepted" if i < fallback else o != "removed")
    for i, m in enumerate(METHODS):
        has, upto = ms.bitwiseAND(1 << i) != 0, ms.bitwiseAND((2 << i) - 1)
        out |= {("method", m): has, ("method_final", m): has & F.col("final"), ("method_cumulative", m): upto != 0, ("method_new", m): upto == 1 << i}
    return out


def _masks(sets: list[Column]) -> list[Column]:
    """The sets a pair is in, as bits of as few longs as hold them."""
    word = lambda conds: reduce(Column.bitwiseOR, [F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(conds)])
    return [word(sets[at : at + _WORD]).alias(f"m{at // _WORD}") for at in range(0, len(sets), _WORD)]


def _listed(sets: list[tuple[str, str]]) -> Column:
    """The sets of the masks, as (t, k)."""
    each = [F.when(F.col(f"m{i // _WORD}").bitwiseAND(F.lit(1 << i % _WORD).cast("long")) != 0, F.struct(F.lit(t).alias("t"), F.lit(k).alias("k"))) for i, (t, k) in enumerate(sets)]
    return F.array_compact(F.array(*each))


def _open_sets() -> Column:
    """The sets whose keys come from the pairs."""
    names = F.array_compact(F.array(*[F.when(F.col("methods").bitwiseAND(1 << i) != 0, m) for i, m in enumerate(METHODS)]))
    flow = F.concat_ws(">", F.coalesce("step", F.lit("none")), F.coalesce(outcome(F.col("validity")), F.lit("unreached")), F.when(F.col("final"), "final").otherwise("rejected"))
    return F.array(_in("agreement", F.size(names)), _in("combination", F.array_join(names, ",")), _in("flow", flow))


def _reached(thresholds: list[float], pool: str) -> Column:
    """How many of the ascending ``thresholds`` a pair's confidence reaches."""
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col(pool)))


def _sweep(low: float, high: float) -> list[float]:
    return [low + (high - low) * i / (SWEEP_POINTS - 1) for i in range(SWEEP_POINTS - 1)] + [high]


def _scores(c: Count, n_gold: int) -> tuple[int, int, int, float, float, float]:
    p, r = c.n_correct / c.n_pairs if c.n_pairs else 0.0, c.n_correct / n_gold if n_gold else 0.0
    return *c, p, r, 2 * p * r / (p + r) if p + r else 0.0


def _observed(seen: Observation, names: list[str]) -> dict:
    """What was observed; of a relation that is known to be empty nothing is, which counts as 0 rows and no range."""
    try:
        return seen.get
    except Py4JJavaError:
        return {n: 0 if n == "n" else None for n in names}


def report(rows: DataFrame, gold: DataFrame | Column, accepted: DataFrame | Column) -> dict[str, DataFrame]:
    """All tables that count pairs, by name.

    ``rows`` are the generated rows with validity and step, ``accepted`` the pairs of the review; it and ``gold`` may be
    conditions on ``rows``. The pairs are built and written once, observed on the way (universe, range of
    confidences), and read by one execution: pairs that are alike in all that is counted are added up before they are
    put into sets, and a pair gets the bits of its kind, which are joined by concept: the many conditions are put to the
    few kinds, not to the pairs. The sums, as many as there are sets, make up
    the tables on the driver. Pools without pairs have no rows in their tables.
    """
    spark = rows.sparkSession
    scratch, seen = Scratch(spark, "report"), Observation()
    reach = [f(p).alias(f"{name}_{p}") for p in POOLS for name, f in (("low", F.min), ("high", F.max))]
    every = pair_table(rows, gold, accepted).observe(seen, F.count_if("made").alias("n"), F.count_if("gold").alias("n_gold"), *reach).filter("made")
    every = scratch.keep(every.drop("made", "gold"), "pairs")
    got = _observed(seen, ["n", "n_gold", *[f"{name}_{p}" for p in POOLS for name in ("low", "high")]])
    n_gold, universe, found = got["n_gold"], got["n"], [p for p in POOLS if got[f"low_{p}"] is not None]
    steps = {("threshold", p): sorted(REPORT_THRESHOLDS) for p in found} | {("sweep", p): _sweep(got[f"low_{p}"], got[f"high_{p}"]) for p in found}
    sets = _fixed_sets()
    keys, masks = list(sets), _masks(list(sets.values()))
    n, none, right = F.count(F.lit(1)).alias("n"), F.lit(0).cast("long"), F.col("in_gold").cast("long")

    def summed(alike: DataFrame, member: Column) -> DataFrame:
        return alike.select("n", (F.col("n") * right).alias("c"), F.explode(member).alias("m")).select("m.t", "m.k", "n", none.alias("h"), "c")

    alike = every.groupBy(*_KIND, "in_gold").agg(n)
    parts = [summed(alike.select("*", *masks), F.concat(_listed(keys), _open_sets()))]
    kinds = alike.select(*_KIND).distinct().select(*masks, *[F.col(c).alias(f"of_{c}") for c in _KIND])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in _KIND])
    concepts = every.select("hpo_id", *_KIND).join(F.broadcast(kinds), same).groupBy("hpo_id").agg(*[F.bit_or(f"m{i}").alias(f"m{i}") for i in range(len(masks))])
    hit = concepts.agg(*[F.coalesce(F.sum(F.shiftright(f"m{i // _WORD}", i % _WORD).bitwiseAND(1)), none).alias(f"s{i}") for i in range(len(keys))])
    each = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k"), F.col(f"s{i}").alias("h")) for i, (t, k) in enumerate(keys)])
    parts.append(hit.select(F.explode(each).alias("m")).select("m.t", "m.k", none.alias("n"), "m.h", none.alias("c")))
    if found:
        reached = [_in(f"{table}:{p}", _reached(ts, p), F.col(p).isNotNull()) for (table, p), ts in steps.items()]
        parts.append(summed(every.filter(F.col(POOLS[2]).isNotNull()).groupBy(*POOLS, "in_gold").agg(n), F.array_compact(F.array(*reached))))
    counts: dict[str, dict[str, Count]] = {}
    for r in reduce(DataFrame.unionByName, parts).groupBy("t", "k").agg(*[F.sum(x).alias(x) for x in "nhc"]).collect():
        counts.setdefault(r["t"], {})[r["k"]] = Count(r["n"], r["h"], r["c"])
    scratch.folder.delete()

    def of(table: str, key: str) -> Count:
        return counts.get(table, {}).get(key, Count())

    def table(rows: list[tuple], columns: str) -> DataFrame:
        return spark.createDataFrame(rows, columns)

    def named(name: str, keys: list[str], column: str) -> DataFrame:
        return table([(k, *_scores(of(name, k), n_gold)) for k in keys], f"{column} string, {_SCORES}")

    stage = [(s, *_scores(of("stage", s), n_gold), of("stage", s).n_correct / universe if universe else 0.0) for s in STAGES]
    out = {"stages": table(stage, f"stage string, {_SCORES}, universe_share double")}
    out["codes"] = named("code", [*map(str, range(ACCEPTED + 1)), "none"], "validity")
    out["methods"] = named("method", list(METHODS), "attribute")
    out["methods_final"] = named("method_final", list(METHODS), "attribute")
    out["methods_cumulative"] = table([(m, *_scores(of("method_cumulative", m), n_gold), of("method_new", m).n_pairs) for m in METHODS], f"attribute string, {_SCORES}, new_pairs long")
    ks = range(1, len(METHODS) + 1)
    above = {k: [of("agreement", str(j)) for j in ks if j >= k] for k in ks}
    out["agreement"] = table([(k, of("agreement", str(k)).n_pairs, of("agreement", str(k)).n_correct, sum(c.n_pairs for c in above[k]), sum(c.n_correct for c in above[k])) for k in ks], "k long, exactly long, exactly_correct long, at_least long, at_least_correct long")
    combos = sorted(((k, *c) for k, c in counts.get("combination", {}).items()), key=lambda x: (-x[3], -x[1], x[0]))
    out["combinations"] = table([(k, n, c, c / n) for k, n, _, c in combos], "combination string, n_pairs long, n_correct long, precision double")
    out["filter_steps"], out["filter_steps_cumulative"] = _step_tables(of, n_gold, table)
    flow: dict[tuple[str, str], list[int]] = {}
    for k, c in counts.get("flow", {}).items():
        step, kind, end = k.split(">")
        for link in ((f"step {step}", kind), (kind, end)):
            n = flow.setdefault(link, [0, 0])
            n[0], n[1] = n[0] + c.n_pairs, n[1] + c.n_correct
    out["flow"] = table([(*k, *n) for k, n in sorted(flow.items())], "source string, target string, n_pairs long, n_correct long")
    for name in ("threshold", "sweep"):
        lines = []
        for p in found:
            ts = steps[name, p]
            for i, t in enumerate(ts, 1):
                reached = [of(f"{name}:{p}", str(j)) for j in range(i, len(ts) + 1)]
                n, _, c, *prf = _scores(Count(sum(x.n_pairs for x in reached), 0, sum(x.n_correct for x in reached)), n_gold)
                if n or name == "threshold":
                    lines.append((p, t, n, c, *prf))
        out[f"{name}s"] = table(lines, "pool string, threshold double, n_pairs long, n_correct long, precision double, recall double, f1 double")
        if name == "sweep":
            # The highest F1 of each pool; the lowest threshold of equal ones.
            best = {p: max((x for x in lines if x[0] == p), key=lambda x: (x[6], -x[1])) for p in found}
            out["best_f1"] = table([(p, x[1], x[6]) for p, x in best.items()], "pool string, threshold double, f1 double")
    out["summary"] = table([("gold", n_gold), ("universe", universe), *((s, of("stage", s).n_pairs) for s in STAGES[2:])], "name string, n_pairs long")
    return out


def _step_tables(of, n_gold: int, table) -> tuple[DataFrame, DataFrame]:
    """Per step the pairs it classified by outcome, with the scores of its output (removed, marked for review or
    accepted pairs); and the scores as of each step: accepted pairs, from the first fallback on all that the review
    gets, then the review's and the final pairs."""
    each, upto, fallback = [], [], False
    for s, label in STEP_LABELS:
        code = STEP_CODE[s]
        kind = "removed" if code == 0 else "review" if code in FALLBACK_CODES else "accepted"
        fallback |= kind == "review"
        each.append((s, label, kind, of("step", s).n_pairs, of("step", s).n_hpo, *(of("step_outcome", f"{s}>{o}").n_pairs for o in OUTCOMES), *_scores(of("step_outcome", f"{s}>{kind}"), n_gold)))
        if code:
            upto.append((s, label, "review" if fallback else "accepted", *_scores(of("step_cumulative", s), n_gold)))
    upto += [(x, x, x, *_scores(of("stage", x), n_gold)) for x in ("llm", "final")]
    counts = ", ".join(f"pairs_{o} long" for o in OUTCOMES)
    return table(each, f"step string, label string, output string, classified_pairs long, classified_hpo long, {counts}, {_SCORES}"), table(upto, f"step string, label string, kind string, {_SCORES}")


def gold_distances(pairs: DataFrame, gold: DataFrame, edges: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """(hpo_id, sct_id, gold_distance, nearest_gold_sct, gold_relation) of the distinct pairs whose source concept has
    gold targets: the nearest of them, the smaller id of equally near ones, and what the pair's target is to it
    (equal, broader, narrower, lateral).

    Targets that aren't among ``concepts`` (concept_id; all, if it isn't given) have no distance; where no gold
    target is reached, the relation is ``gold_not_in_sct``. All targets are climbed once. A concept's gold targets are
    cut to the nearest one below each of their ancestors before its pairs meet them, so the work grows with the pairs
    and the gold pairs and not with their products.
    """
    g = gold.select("hpo_id", F.col("sct_id").alias("g")).distinct()
    p = pairs.select(*PAIR).distinct().join(g.select("hpo_id").distinct(), "hpo_id", "left_semi")
    ids = p.select(F.col("sct_id").alias("concept_id")).unionByName(g.select(F.col("g").alias("concept_id"))).distinct()
    if concepts is not None:
        ids = ids.join(concepts.select("concept_id").distinct(), "concept_id", "left_semi")
    up = distances.climb(ids, edges)
    below = g.join(up.select(F.col("start").alias("g"), "node", "steps"), "g").groupBy("hpo_id", "node").agg(F.min(F.struct("steps", "g")).alias("m"))
    met = p.join(up.select(F.col("start").alias("sct_id"), "node", "steps"), "sct_id", "left").join(below, ["hpo_id", "node"], "left")
    apart = F.struct((F.col("steps") + F.col("m.steps")).alias("distance"), F.col("m.g").alias("g"))
    near = met.groupBy(*PAIR).agg(F.min(F.when(F.col("m").isNotNull(), apart)).alias("m"))
    near = near.select(*PAIR, F.col("m.distance").alias("gold_distance"), F.col("m.g").alias("nearest_gold_sct"))
    for name, top, bottom in (("over", "sct_id", "nearest_gold_sct"), ("under", "nearest_gold_sct", "sct_id")):
        near = near.join(up.select(F.col("node").alias(top), F.col("start").alias(bottom), F.lit(True).alias(name)), ["sct_id", "nearest_gold_sct"], "left")
    d = F.col("gold_distance")
    kind = F.when(d.isNull(), UNMEASURED).when(d == 0, "equal").when(F.col("over"), "broader").when(F.col("under"), "narrower").otherwise("lateral")
    return near.select(*PAIR, "gold_distance", "nearest_gold_sct", kind.alias("gold_relation"))


_BUCKETS = [*map(str, range(DISTANCE_CAP)), f"{DISTANCE_CAP}+"]


def _sets(near: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """``near`` under the name of every set that has its pair."""
    d = F.col("gold_distance")
    bucket = F.when(d.isNull(), UNMEASURED).when(d >= DISTANCE_CAP, _BUCKETS[-1]).otherwise(d.cast("string"))
    for name, pairs in sets.items():
        near = _flag(near, pairs, f"_{name}")
    names = F.array_compact(F.array(*[F.when(F.col(f"_{n}"), F.lit(n)) for n in sets]))
    return near.select(F.explode(names).alias("set"), bucket.alias("bucket"), "gold_distance", "gold_relation")


def distance_table(near: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """Per set of pairs and distance bucket: n_pairs, share and cumulative share among the set's pairs, and the
    relations of those apart. Pairs without a distance have their own bucket, which isn't cumulated."""
    kind = lambda k: F.coalesce(F.sum((F.col("gold_relation") == k).cast("long")), F.lit(0)).alias(k)
    found = {(r["set"], r["bucket"]): r for r in _sets(near, sets).groupBy("set", "bucket").agg(F.count(F.lit(1)).alias("n"), kind("broader"), kind("narrower"), kind("lateral")).collect()}
    out = []
    for name in sets:
        total, upto = sum(r["n"] for (s, _), r in found.items() if s == name), 0
        for b in [*_BUCKETS, UNMEASURED]:
            r = found.get((name, b))
            n = r["n"] if r else 0
            upto += n
            out.append((name, b, n, n / total if total else 0.0, None if b == UNMEASURED else upto / total if total else 0.0, *((r["broader"], r["narrower"], r["lateral"]) if r else (0, 0, 0))))
    return near.sparkSession.createDataFrame(out, "set string, bucket string, n_pairs long, share double, cumulative double, broader long, narrower long, lateral long")


def distance_summary(near: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """Per set: n_pairs, n_measured, n_wrong (a distance over 0), their mean and exact median distance."""
    wrong = F.when(F.col("gold_distance") > 0, F.col("gold_distance"))
    return _sets(near, sets).groupBy("set").agg(F.count(F.lit(1)).alias("n_pairs"), F.count("gold_distance").alias("n_measured"), F.count(wrong).alias("n_wrong"), F.avg(wrong).alias("mean_wrong"), F.median(wrong).alias("median_wrong"))


def missed_distances(final: DataFrame, gold: DataFrame, edges: DataFrame) -> DataFrame:
    """The gold pairs that aren't final, of concepts with final pairs: distance to the nearest final target, and what that is to the gold target."""
    turned = {"broader": "narrower", "narrower": "broader"}
    missed = gold.select(*PAIR).distinct().join(final.select(*PAIR).distinct(), PAIR, "left_anti")
    near = gold_distances(missed, final, edges).withColumnRenamed("nearest_gold_sct", "nearest_final_sct")
    kind = F.col("gold_relation")
    return near.withColumn("gold_relation", F.when(kind == "broader", turned["broader"]).when(kind == "narrower", turned["narrower"]).otherwise(kind))


def depth_table(sets: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """Per set of concepts (a column of ids): n, mean, median, least and greatest depth, and the numbers in five buckets.

    A concept's depth is the greatest of its fewest steps to an ancestor; roots and unknown concepts have 0. All sets
    are climbed at once.
    """
    members = None
    for name, ids in sets.items():
        part = ids.select(F.lit(name).alias("set"), F.col(ids.columns[0]).alias("id")).filter("id IS NOT NULL").distinct()
        members = part if members is None else members.unionByName(part)
    depth = distances.climb(members.select("id"), edges).groupBy(F.col("start").alias("id")).agg(F.max("steps").alias("depth"))
    d = F.col("depth")
    buckets = [F.sum(((d >= lo) & (d <= hi) if hi is not None else d >= lo).cast("long")).alias(f"n_{lo}_{hi}" if hi is not None else f"n_{lo}_up") for lo, hi in DEPTH_BUCKETS]
    return members.join(depth, "id").groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.min(d).alias("least"), F.max(d).alias("greatest"), *buckets)


def structure(sets: dict[str, DataFrame], source_edges: DataFrame, target_edges: DataFrame) -> dict[str, DataFrame]:
    """Structural warnings for several sets of pairs, from one climb in each hierarchy.

    ``source_collapse`` (set, hpo_id, broader, narrower): targets of one concept, one above the other.
    ``target_collapse`` (set, sct_id, broader, narrower): concepts with one target, one above the other.
    ``reversals`` (set, parent, child, parent_sct, child_sct): the parent's target lies below the child's.
    ``counts`` (set, warning, n_pairs, n_concepts): concepts are those of the first column after the set (children of reversals).
    """
    every = None
    for name, pairs in sets.items():
        part = pairs.select(F.lit(name).alias("set"), *PAIR).distinct()
        every = part if every is None else every.unionByName(part)
    every = Scratch(every.sparkSession, "structure").keep(every, "pairs")
    source_up, target_up = (distances.climb(every.select(c), e) for c, e in (("hpo_id", source_edges), ("sct_id", target_edges)))
    a = distances.related_pairs(every.withColumn("id", F.col("sct_id")), target_up, ["set", "hpo_id"])
    b = distances.related_pairs(every.withColumn("id", F.col("hpo_id")), source_up, ["set", "sct_id"])
    # a child's pair and a parent's meet by the parent and the child's target, so that no two pairs meet in vain
    over = source_up.filter("start != node").select(F.col("start").alias("child"), F.col("node").alias("parent"))
    below = target_up.filter("start != node").select(F.col("start").alias("parent_sct"), F.col("node").alias("child_sct"))
    child = every.select("set", F.col("hpo_id").alias("child"), F.col("sct_id").alias("child_sct")).join(over, "child")
    parent = every.select("set", F.col("hpo_id").alias("parent"), F.col("sct_id").alias("parent_sct")).join(below, "parent_sct")
    c = child.join(parent, ["set", "parent", "child_sct"]).select("set", "parent", "child", "parent_sct", "child_sct")
    counts = None
    for name, df, of in (("source_collapse", a, "hpo_id"), ("target_collapse", b, "sct_id"), ("reversals", c, "child")):
        part = df.groupBy("set").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct(of).alias("n_concepts")).select("set", F.lit(name).alias("warning"), "n_pairs", "n_concepts")
        counts = part if counts is None else counts.unionByName(part)
    return {"source_collapse": a, "target_collapse": b, "reversals": c, "counts": counts}


def pair_details(info: DataFrame, near: DataFrame, source_labels: DataFrame, target_labels: DataFrame) -> DataFrame:
    """The pair-level columns of all outputs: ``info`` (``evaluation.pair_info``) with both labels and the nearest gold target.

    Labels are (concept_id, ord, value): a source concept has its first, a target its first with an acceptable tag,
    else its first, and both their id where there is none. Concepts without gold targets have the relation ``no_gold``.
    """
    first = source_labels.filter("value IS NOT NULL").groupBy(F.col("concept_id").alias("hpo_id")).agg(F.min(F.struct("ord", "value"))["value"].alias("hpo_label"))
    fits = ~F.coalesce(domain_ok(semantic_tag("value")), F.lit(False))
    best = target_labels.filter("value IS NOT NULL").groupBy(F.col("concept_id").alias("sct_id")).agg(F.min(F.struct(fits.alias("off"), "ord", "value"))["value"].alias("sct_label"))
    p = info.join(near.select(*PAIR, "gold_distance", "nearest_gold_sct", "gold_relation"), PAIR, "left").join(first, "hpo_id", "left").join(best, "sct_id", "left")
    named = {"hpo_label": F.coalesce("hpo_label", F.col("hpo_id").cast("string")), "sct_label": F.coalesce("sct_label", F.col("sct_id").cast("string")), "gold_relation": F.coalesce("gold_relation", F.lit("no_gold"))}
    return p.withColumns(named).select("hpo_id", "hpo_label", "sct_id", "sct_label", "auto_accepted", "llm_accepted", "original_validity", "methods", "best_conf", "gold_distance", "nearest_gold_sct", "gold_relation", "in_gold")


def evaluation_final(rows: DataFrame, details: DataFrame, review: DataFrame) -> DataFrame:
    """Every mapping row of the pairs in ``details`` with their columns and the review's rationale; an empty ``review`` gives nulls."""
    why = review.groupBy(*PAIR).agg(F.max("llm_rationale").alias("llm_rationale"))
    return rows.join(details, PAIR).join(why, PAIR, "left")


def without_gold(details: DataFrame) -> DataFrame:
    """The pairs of concepts without gold targets, which can't be checked."""
    return details.filter("gold_relation = 'no_gold'").drop("in_gold")


def disagreements(details: DataFrame, review: DataFrame) -> DataFrame:
    """Pairs that only the rules or only the review accepted, with what the review said, in order."""
    said = review.groupBy(*PAIR).agg(F.max(F.struct("llm_pass", "llm_decision", F.col("confidence").alias("llm_confidence"), "llm_rationale")).alias("r")).select(*PAIR, "r.*")
    kind = F.when(F.col("auto_accepted"), "auto_accepted_llm_rejected").otherwise("candidate_llm_accepted")
    reason = F.create_map(*[F.lit(x) for c, r in REVIEW_REASON.items() for x in (c, r)])
    out = details.filter("auto_accepted != llm_accepted").withColumns({"disagreement": kind, "review_reason": F.coalesce(F.try_element_at(reason, F.col("original_validity").cast("int")), F.lit(""))})
    return out.join(said, PAIR, "left").orderBy("disagreement", *PAIR)
