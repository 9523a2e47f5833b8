"""The rule cascade: validity code and step of each candidate pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestitch.constants import ACCEPTED, EPSILON, REFERENCE_METHODS, STEP_CODE

from lodestitch.functions.storage import materialise

from .hierarchy import depth, related_candidates

PAIR = ["hpo_id", "sct_id"]
ORDER = ["2", "2b", "2c", "3", "4", "5", "6"]


def exact(confidence: str = "confidence") -> Column:
    return F.abs(F.col(confidence) - 1) < EPSILON


def pair_flags(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """One row per pair: which methods found it, how exactly, and whether its target's domain (sct_id, ok) fits."""

    def any_of(cond: Column) -> Column:
        return F.coalesce(F.bool_or(cond), F.lit(False))

    method = F.col("attribute")
    flags = rows.repartition(*PAIR).groupBy(*PAIR).agg(
        any_of(method == "hpo_sct").alias("xref"), any_of(method == "hpo_umls_sct").alias("bridge"), any_of(method == "umls_hpo_sct").alias("shared"),
        any_of(method == "exact_lexical").alias("lex"), any_of((method == "jaccard") & exact()).alias("j1"), any_of((method == "embedding") & exact()).alias("c1"),
        F.bit_or(F.coalesce(*[F.when(method == m, F.lit(1 << i)) for i, m in enumerate(REFERENCE_METHODS)])).alias("refs"), F.max("confidence").alias("best_conf"),
        F.max(F.when(method == "embedding", F.col("confidence"))).alias("cosine"), F.max(F.when(method == "jaccard", F.col("confidence"))).alias("jaccard"),
    )
    flags = flags.withColumn("refs", F.bit_count(F.coalesce("refs", F.lit(0))).cast("long"))
    ok = domains.groupBy("sct_id").agg(F.bool_or("ok").alias("ok"))
    return flags.join(ok, "sct_id", "left").withColumn("dom_ok", F.coalesce("ok", F.lit(False))).drop("ok")


def phase(flags: DataFrame) -> DataFrame:
    """With the step that a pair qualifies for (null: the fallbacks only) and its evidence (lexicographic order)."""
    alike = F.col("j1") | F.col("c1")
    alone = F.col("refs") == 0
    step = (
        F.when(~F.col("dom_ok"), "1").when(F.col("xref") & F.col("lex"), "2").when(F.col("lex"), "2b").when(F.col("xref") & alike, "2c")
        .when(F.col("bridge") & alike, "3").when(F.col("shared") & alike, "4").when(alone & F.col("j1") & F.col("c1"), "5").when(alone & F.col("j1"), "6")
    )
    lexical = F.when(F.col("lex"), 2).when(F.col("j1"), 1).otherwise(0)
    return flags.withColumn("phase", step).withColumn("evidence", F.struct(F.col("refs").cast("int").alias("refs"), lexical.alias("lexical"), F.col("c1").cast("int").alias("cos1")))


def _fold(candidates: list[tuple]) -> dict[str, int]:
    """Accept, reject or demote the related candidates (target, step, evidence, broader ones) of one concept in their order."""
    accepted: set[str] = set()
    code: dict[str, int] = {}
    evidence, above, steps = {}, {}, {}
    for sct, own, ev, up in candidates:
        evidence[sct], above[sct], steps[sct] = tuple(ev), set(up), own
        over = accepted & above[sct]
        under = [t for t in accepted if sct in above[t]]
        if any(evidence[t] >= evidence[sct] for t in under) or any(evidence[t] > evidence[sct] for t in over):
            code[sct] = STEP_CODE[own]
            continue
        for t in {*over, *under}:
            accepted.discard(t)
            code[t] = STEP_CODE[steps[t]]
        accepted.add(sct)
        code[sct] = ACCEPTED
    return code


def _folds(kind: pa.DataType, target: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The folds of rows that come concept by concept, in their order; a call per concept costs more than its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], []

        def coded() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [(), (), ()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, target, pa.int32()), strict=True)], ["hpo_id", "sct_id", "validity"])

        for b in batches:
            for hpo, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and hpo != now:
                    done.extend((now, *x) for x in _fold(held).items())
                    held = []
                now = hpo
                held.append(row)
            yield coded()
        if held:
            done.extend((now, *x) for x in _fold(held).items())
            yield coded()

    return run


def resolve(candidates: DataFrame, reach: DataFrame) -> DataFrame:
    """(hpo_id, sct_id, validity) of the candidates of steps 2 to 6.

    Only candidates with a related candidate of their concept meet in a fold; all others are accepted natively.
    Order: step, then (step 2) deeper targets first, then confidence downwards, then target id.
    """
    n = depth(reach).select(F.col("node").alias("sct_id"), "n_ancestors")
    c = candidates.filter(F.col("phase").isin(*ORDER)).join(n, "sct_id", "left")
    deep = F.when(F.col("phase") == "2", -F.coalesce("n_ancestors", F.lit(0)).cast("double")).when(F.col("phase") != "2b", -F.col("best_conf")).otherwise(0.0)
    step = F.array_position(F.array(*map(F.lit, ORDER)), F.col("phase"))
    c = c.select(*PAIR, "phase", F.array("evidence.refs", "evidence.lexical", "evidence.cos1").alias("ev"), F.struct(step.alias("step"), deep.alias("deep"), "sct_id").alias("key"))
    links = related_candidates(c, reach)
    up = links.groupBy("hpo_id", F.col("narrower").alias("sct_id")).agg(F.collect_set("broader").alias("broader"))
    tied = links.select("hpo_id", F.explode(F.array("broader", "narrower")).alias("sct_id")).distinct()
    free = c.join(tied, PAIR, "left_anti").select(*PAIR, F.lit(ACCEPTED).alias("validity"))
    met = c.join(tied, PAIR, "left_semi").join(up, PAIR, "left")
    met = met.withColumn("broader", F.coalesce("broader", F.array().cast("array<string>"))).repartition("hpo_id").sortWithinPartitions("hpo_id", "key")
    schema = f"hpo_id {candidates.schema['hpo_id'].dataType.simpleString()}, sct_id {candidates.schema['sct_id'].dataType.simpleString()}, validity int"
    arrow = [to_arrow_type(candidates.schema[c].dataType) for c in PAIR]
    return free.unionByName(met.select(*PAIR, "phase", "ev", "broader").mapInArrow(_folds(*arrow), schema))


def _missing(rows: DataFrame, coded: DataFrame) -> DataFrame:
    return rows.join(coded.select("hpo_id").distinct(), "hpo_id", "left_anti")


def best_candidate(flags: DataFrame, handled: DataFrame) -> DataFrame:
    """Step 7: of a concept without codes 1-7 or 10, the domain-valid pair that is best by cosine and by Jaccard among those."""
    open_ = _missing(flags.filter("dom_ok"), handled)

    def place(c: str) -> Column:
        return F.row_number().over(Window.partitionBy("hpo_id").orderBy(F.col(c).desc_nulls_last(), "sct_id"))

    first = open_.withColumn("by_cosine", place("cosine")).withColumn("by_jaccard", place("jaccard"))
    return first.filter("by_cosine = 1 AND by_jaccard = 1 AND cosine IS NOT NULL AND jaccard IS NOT NULL").select(*PAIR, F.lit(STEP_CODE["7"]).alias("validity"))


def last_resort(flags: DataFrame, handled: DataFrame) -> DataFrame:
    """Step 8: all domain-valid pairs of a still unmapped concept that tie for its highest cosine."""
    pool = _missing(flags.filter("dom_ok AND cosine IS NOT NULL"), handled)
    top = pool.withColumn("top", F.max("cosine").over(Window.partitionBy("hpo_id")))
    return top.filter(F.col("cosine") >= F.col("top") - EPSILON).select(*PAIR, F.lit(STEP_CODE["8"]).alias("validity"))


def assign(rows: DataFrame, domains: DataFrame, reach: DataFrame) -> DataFrame:
    """(hpo_id, sct_id, validity, step) of every pair; both null where no step reaches it.

    Flags, the fold's codes and step 7 are each read several times, so they are written out once.
    """
    flags = materialise(phase(pair_flags(rows, domains)))
    coded = materialise(resolve(flags, reach))
    eight = materialise(best_candidate(flags, coded))
    nine = last_resort(flags, coded.unionByName(eight))
    zero = flags.filter("phase = '1'").select(*PAIR, F.lit(0).alias("validity"))
    every = zero.unionByName(coded).unionByName(eight).unionByName(nine)
    step_of = F.create_map(*[F.lit(x) for s, c in STEP_CODE.items() for x in (c, s)])
    out = flags.select(*PAIR, "phase").join(every, PAIR, "left")
    return out.select(*PAIR, "validity", F.when(F.col("validity") == ACCEPTED, F.col("phase")).otherwise(F.try_element_at(step_of, "validity")).alias("step"))
