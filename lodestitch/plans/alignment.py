"""Queries of hierarchy, cascade, evaluation and review operators over the star schema, with their SQL.

Source concepts are parts; targets are suppliers and their nations, under one hierarchy
region > nation > supplier > part, in which a part has several suppliers.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.constants import METHODS, REPORT_THRESHOLDS, REVIEW_REASON, STEP_CODE, SWEEP_POINTS
from lodestitch.functions import text
from lodestitch.operators import cascade, embedding, evaluation, hierarchy, review
from lodestitch.sources import terminology


def _t(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _id(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def edges(s: SparkSession, d: str) -> DataFrame:
    n, sup, li = _t(s, d, "nation"), _t(s, d, "supplier"), _t(s, d, "lineitem")
    e = n.select(_id("R", "n_regionkey").alias("parent"), _id("N", "n_nationkey").alias("child"))
    e = e.unionByName(sup.select(_id("N", "s_nationkey").alias("parent"), _id("S", "s_suppkey").alias("child")))
    return e.unionByName(li.select(_id("S", "l_suppkey").alias("parent"), _id("P", "l_partkey").alias("child")))


def target_edges(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d).filter("NOT startswith(child, 'P')")


def rows(s: SparkSession, d: str) -> DataFrame:
    """Mapping rows with a synthetic method, confidence, code and step; gold rows are the returned ones."""
    li = _t(s, d, "lineitem").join(_t(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("nk")), "l_suppkey")
    even = F.col("l_linenumber") % 2 == 0
    method = F.element_at(F.array(*map(F.lit, METHODS)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 6 + 1).cast("int"))
    near = method.isin("jaccard", "embedding") & (F.col("l_quantity") <= 25)
    code = (F.col("l_partkey") * 7 + F.when(even, F.col("nk")).otherwise(F.col("l_suppkey"))) % 12
    out = li.select(
        _id("P", "l_partkey").alias("hpo_id"), F.when(even, _id("N", "nk")).otherwise(_id("S", "l_suppkey")).alias("sct_id"), method.alias("attribute"),
        F.when(near, F.round(F.col("l_discount") + 0.76, 6)).otherwise(1.0).alias("confidence"), F.when(code < 11, code).alias("validity"), (F.col("l_returnflag") == "R").alias("gold"),
    )
    steps = F.create_map(*[F.lit(x) for k, c in STEP_CODE.items() for x in (c, k)])
    return out.withColumn("step", F.when(F.col("validity") == 10, "2").otherwise(F.try_element_at(steps, F.col("validity").cast("int"))))


def gold(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d).filter("gold").select("hpo_id", "sct_id").distinct()


def final(s: SparkSession, d: str) -> DataFrame:
    return rows(s, d).filter("validity >= 9").select("hpo_id", "sct_id").distinct()


def domains(s: SparkSession, d: str) -> DataFrame:
    sup = _t(s, d, "supplier").select(_id("S", "s_suppkey").alias("sct_id"), (F.col("s_suppkey") % 10 != 0).alias("ok"))
    return sup.unionByName(_t(s, d, "nation").select(_id("N", "n_nationkey").alias("sct_id"), F.lit(True).alias("ok")))


def _neighbours(s: SparkSession, d: str) -> DataFrame:
    p = _t(s, d, "part")
    return p.select(_id("P", "p_partkey").alias("a"), F.concat(F.lit("P"), (F.col("p_partkey") + 7).cast("string")).alias("b"))


def hierarchy_distance(s: SparkSession, d: str) -> DataFrame:
    return hierarchy.distance(_neighbours(s, d), edges(s, d))


def hierarchy_relation(s: SparkSession, d: str) -> DataFrame:
    pairs = rows(s, d).select(F.col("sct_id").alias("a"), F.col("hpo_id").alias("b"))
    return hierarchy.relation(pairs, hierarchy.closure(edges(s, d)))


def _four_places(c: str) -> Column:
    """A positive double at four places as the SQL has it: by its binary value, where Spark's round takes the decimal digits (0.31375)."""
    return F.floor(F.col(c) * 10000 + 0.5) / 10000


def cosine_pairs(s: SparkSession, d: str) -> DataFrame:
    """Even with odd ids: two sides without a common row, for tests of the blocks. Not registered, as it leaves out pairs."""
    v = _t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    out = embedding.cosine_join(v.filter("id % 2 = 0"), v.filter("id % 2 = 1"), 0.3)
    return out.withColumn("confidence", _four_places("confidence"))


def cosine_pairs_all(s: SparkSession, d: str) -> DataFrame:
    """All pairs of different embeddings, each once."""
    v = _t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    out = embedding.cosine_self_join(v, 0.3)
    return out.withColumn("confidence", _four_places("confidence"))


def pair_phases(s: SparkSession, d: str) -> DataFrame:
    p = cascade.phase(cascade.pair_flags(rows(s, d), domains(s, d)))
    return p.select("hpo_id", "sct_id", "phase", F.col("evidence.refs").alias("refs"), F.col("evidence.lexical").alias("lexical"), F.col("evidence.cos1").alias("cos1"))


def cascade_assign(s: SparkSession, d: str) -> DataFrame:
    return cascade.assign(rows(s, d), domains(s, d), hierarchy.closure(target_edges(s, d)))


def cross_reversal(s: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as children of it; the targets are reversed nations."""
    n = _t(s, d, "nation")
    src = n.select(_id("R", "n_regionkey").alias("parent"), _id("N", "n_nationkey").alias("child"))
    tgt = n.select(_id("b", "n_nationkey").alias("parent"), _id("a", "n_regionkey").alias("child"))
    pairs = n.select(_id("R", "n_regionkey").alias("hpo_id"), _id("a", "n_regionkey").alias("sct_id")).unionByName(n.select(_id("N", "n_nationkey").alias("hpo_id"), _id("b", "n_nationkey").alias("sct_id")))
    return hierarchy.cross_reversal(pairs, hierarchy.closure(src), hierarchy.closure(tgt))


def nearest_target(s: SparkSession, d: str) -> DataFrame:
    p, g = final(s, d), gold(s, d)
    met = p.select("hpo_id", F.col("sct_id").alias("a")).join(g.select("hpo_id", F.col("sct_id").alias("b")), "hpo_id").select("a", "b")
    return evaluation.nearest_target(p, g, hierarchy.distance(met, target_edges(s, d)))


def _info(s: SparkSession, d: str) -> DataFrame:
    return evaluation.pair_info(rows(s, d), gold(s, d), rows(s, d).filter("attribute = 'jaccard'"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Answers made of the events' JSON: their number is the confidence, every third is no JSON."""
    k = F.get_json_object("props", "$.k")
    good = F.concat(F.lit('{"rationale": "r", "decision": "'), F.when(F.col("event_type") == "purchase", "accept").otherwise("REJECT"), F.lit('", "confidence": '), F.coalesce(k, F.lit("0")), F.lit("}"))
    return _t(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "no answer").otherwise(good).alias("answer"))


def stub(prompts: list[str]) -> list[str]:
    """A model that accepts candidates whose block has an even length; one answer per candidate id."""
    out = []
    for p in prompts:
        blocks = re.findall(r"^\* ID: (\S+)$(.*?)(?=^---$|\Z)", p, re.M | re.S)
        out.append(json.dumps({"mappings": [{"sct_id": i, "rationale": "length", "decision": "ACCEPT" if len(b) % 2 == 0 else "REJECT", "confidence": 1 + len(b) % 5} for i, b in blocks]}))
    return out


def review_prompts(s: SparkSession, d: str) -> DataFrame:
    concepts = _t(s, d, "part").select(_id("P", "p_partkey").alias("concept_id"), F.lit("label").alias("attribute"), F.col("p_name").alias("value"))
    targets = _t(s, d, "supplier").select(_id("S", "s_suppkey").alias("concept_id"), F.col("s_name").alias("value"))
    targets = targets.unionByName(_t(s, d, "nation").select(_id("N", "n_nationkey").alias("concept_id"), F.col("n_name").alias("value"))).withColumn("attribute", F.lit("label"))
    e = target_edges(s, d)
    return review.prompts(review.select_pairs(rows(s, d)), review.describe(concepts, e), review.describe(targets, e), hierarchy.closure(e))


def review_stub(s: SparkSession, d: str) -> DataFrame:
    """Decisions of the stub on every reviewed pair, both passes."""
    return review.parse_group(review.select_pairs(rows(s, d)), review.generate(review_prompts(s, d), stub, "stub"))


GOLD_ROWS = [("H1", "12345 |Seizure|"), ("H2", "123456789012345678"), ("H3", "1:2=3"), ("H4", "1+2"), ("H5", "1.2E+08"), ("H6", "1.5"), ("H7", "abc"), ("H8", "0"), ("H9", "-3"), ("H10", "007"), ("H11", "12.0")]


def gold_load(s: SparkSession, d: str) -> DataFrame:
    raw = s.createDataFrame([(a, "One to one match", b) for a, b in GOLD_ROWS], "HP_ID string, `Match group` string, `SNOMED term/exp` string")
    return terminology.gold_pairs(raw)


def terms(s: SparkSession, d: str) -> DataFrame:
    p = _t(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("fsn"))
    return p.select("p_partkey", text.semantic_tag("fsn").alias("tag"), text.strip_tag("fsn").alias("term"), text.norm_key("fsn").alias("key"), text.domain_ok(text.semantic_tag("fsn")).alias("ok"))


QUERIES = {
    "hierarchy_closure": lambda s, d: hierarchy.closure(edges(s, d)),
    "hierarchy_depth": lambda s, d: hierarchy.depth(hierarchy.closure(edges(s, d))),
    "hierarchy_distance": hierarchy_distance,
    "hierarchy_relation": hierarchy_relation,
    "related_candidates": lambda s, d: hierarchy.related_candidates(rows(s, d), hierarchy.closure(target_edges(s, d))),
    "target_collapse": lambda s, d: hierarchy.target_collapse(rows(s, d).select(F.col("sct_id").alias("hpo_id"), F.col("hpo_id").alias("sct_id")), hierarchy.closure(target_edges(s, d))),
    "cross_reversal": cross_reversal,
    "cosine_pairs_all": cosine_pairs_all,
    "pair_phases": pair_phases,
    "cascade_assign": cascade_assign,
    "evaluation_returned": lambda s, d: evaluation.evaluation(final(s, d), gold(s, d)),
    "threshold_counts": lambda s, d: evaluation.threshold_counts(rows(s, d), gold(s, d)),
    "pr_curve": lambda s, d: evaluation.pr_curve(rows(s, d), gold(s, d), 0.75),
    "method_table": lambda s, d: evaluation.method_table(rows(s, d), gold(s, d)),
    "method_combinations": lambda s, d: evaluation.method_combinations(rows(s, d), gold(s, d)),
    "pairwise_overlap": lambda s, d: evaluation.pairwise_overlap(rows(s, d)),
    "method_agreement": lambda s, d: evaluation.agreement(rows(s, d), gold(s, d)),
    "code_counts": lambda s, d: evaluation.code_counts(rows(s, d)),
    "step_outcomes": lambda s, d: evaluation.step_outcomes(rows(s, d)),
    "coverage": lambda s, d: evaluation.coverage(rows(s, d).filter("attribute = 'jaccard'"), final(s, d), gold(s, d)),
    "any_all_exact": lambda s, d: evaluation.any_all_exact(final(s, d), gold(s, d)),
    "missed_diagnosis": lambda s, d: evaluation.diagnose(rows(s, d).filter("attribute != 'hpo_sct'"), final(s, d), gold(s, d)),
    "nearest_target": nearest_target,
    "pipeline_flow": lambda s, d: evaluation.pipeline_flow(rows(s, d), final(s, d)),
    "pair_info": _info,
    "accepted_without_gold": lambda s, d: evaluation.accepted_without_gold(_info(s, d), gold(s, d)),
    "llm_disagreements": lambda s, d: evaluation.disagreements(_info(s, d)),
    "review_select": lambda s, d: review.select_pairs(rows(s, d)),
    "review_prompts": review_prompts,
    "review_stub": review_stub,
    "review_parse": lambda s, d: review.parse_pair(_answers(s, d)),
    "gold_load": gold_load,
    "term_functions": terms,
}

_EDGES = """e AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
    UNION SELECT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem)"""
_UP = f"WITH RECURSIVE {_EDGES}, w AS (SELECT parent AS ancestor, child AS descendant, 1 AS s FROM e UNION SELECT w.ancestor, e.child, w.s + 1 FROM w JOIN e ON w.descendant = e.parent), c AS (SELECT ancestor, descendant, min(s) AS min_steps FROM w GROUP BY ALL)"
_METHOD = "list_extract([" + ", ".join(f"'{m}'" for m in METHODS) + "], CAST((l_orderkey + l_linenumber) % 6 + 1 AS INT))"
_STEP = "CASE validity " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in STEP_CODE.items()) + " WHEN 10 THEN '2' END"
_ROWS = f"""b AS (SELECT 'P' || l_partkey AS hpo_id, CASE WHEN l_linenumber % 2 = 0 THEN 'N' || s_nationkey ELSE 'S' || l_suppkey END AS sct_id, {_METHOD} AS attribute, l_quantity, l_discount, l_returnflag = 'R' AS gold,
    (l_partkey * 7 + CASE WHEN l_linenumber % 2 = 0 THEN s_nationkey ELSE l_suppkey END) % 12 AS code FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    r0 AS (SELECT hpo_id, sct_id, attribute, CASE WHEN attribute IN ('jaccard', 'embedding') AND l_quantity <= 25 THEN round(l_discount + 0.76, 6) ELSE 1.0 END AS confidence, CASE WHEN code < 11 THEN code END AS validity, gold FROM b),
    r AS (SELECT *, {_STEP} AS step FROM r0), p AS (SELECT DISTINCT hpo_id, sct_id FROM r), g AS (SELECT DISTINCT hpo_id, sct_id FROM r WHERE gold), f AS (SELECT DISTINCT hpo_id, sct_id FROM r WHERE validity >= 9)"""
_R = f"WITH {_ROWS}"
_UPR = _UP.replace(_EDGES, _EDGES + ", " + _ROWS)
_OK = "(hpo_id, sct_id) IN (SELECT (hpo_id, sct_id) FROM g)"
_M = f"{_R}, m AS (SELECT hpo_id, sct_id, list_sort(list(DISTINCT attribute)) AS ms, {_OK} AS ok FROM r GROUP BY hpo_id, sct_id)"
_RANK = "list_position([" + ", ".join(f"'{m}'" for m in METHODS) + "], {})"
_ZERO = "coalesce(CAST({} AS DOUBLE) / nullif({}, 0), 0)"
_OUT = "CASE WHEN validity = 10 THEN 'accepted' WHEN validity = 0 THEN 'removed' WHEN validity IN (8, 9) THEN 'review' WHEN validity IS NOT NULL THEN 'conflict' END"
_INFO = f"{_R}, i AS (SELECT hpo_id, sct_id, max(validity) AS original_validity, array_to_string(list_sort(list(DISTINCT attribute)), ',') AS methods, max(confidence) AS best_conf, coalesce(max(validity) = 10, false) AS auto_accepted, {_OK} AS in_gold, bool_or(attribute = 'jaccard') AS llm_accepted FROM r GROUP BY hpo_id, sct_id)"
_NEAR = f"""{_UPR}, t AS (SELECT descendant AS node, ancestor, min_steps AS s FROM c WHERE descendant NOT LIKE 'P%' UNION ALL SELECT x, x, 0 FROM (SELECT DISTINCT unnest([parent, child]) AS x FROM e) WHERE x NOT LIKE 'P%'),
    pr AS (SELECT DISTINCT f.hpo_id, f.sct_id, g.sct_id AS t FROM f JOIN g USING (hpo_id)),
    di AS (SELECT hpo_id, sct_id, t, min(x.s + y.s) AS d FROM pr JOIN t x ON x.node = pr.sct_id JOIN t y ON y.node = pr.t AND y.ancestor = x.ancestor GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY hpo_id, sct_id ORDER BY d, t) AS n FROM di),
    nt AS (SELECT f.hpo_id, f.sct_id, d AS gold_distance, t AS nearest_gold_sct FROM f LEFT JOIN (SELECT * FROM k WHERE n = 1) USING (hpo_id, sct_id))"""


def _counts(steps: tuple[float, ...]) -> str:
    values = ", ".join(f"({t!r}::DOUBLE)" for t in steps)
    return f"""{_R}, x AS (SELECT hpo_id, sct_id, max(confidence) AS c, {_OK} AS ok FROM r GROUP BY hpo_id, sct_id), s AS (SELECT t, lag(t) OVER (ORDER BY t DESC) AS before FROM (VALUES {values}) v(t)),
        y AS (SELECT t AS threshold, count(*) FILTER (c >= t AND (before IS NULL OR c < before)) AS n_bucket, count(*) FILTER (c >= t AND (before IS NULL OR c < before) AND ok) AS correct_bucket,
        count(*) FILTER (c >= t) AS n_pairs, count(*) FILTER (c >= t AND ok) AS n_correct FROM s CROSS JOIN x GROUP BY t, before), z AS (SELECT *, {_ZERO.format("n_correct", "n_pairs")} AS precision FROM y)"""


_SWEEP = tuple(0.75 + 0.25 * i / (SWEEP_POINTS - 1) for i in range(SWEEP_POINTS))
_REASON = "CASE validity " + " ".join(f"WHEN {c} THEN '{x}'" for c, x in REVIEW_REASON.items()) + " END"

ORACLE_SQL = {
    "hierarchy_closure": _UP + " SELECT * FROM c",
    "hierarchy_depth": _UP + " SELECT descendant AS node, count(*) AS n_ancestors, max(min_steps) AS max_steps FROM c GROUP BY 1",
    "hierarchy_distance": _UP + """, a AS (SELECT descendant AS node, ancestor, min_steps AS s FROM c WHERE descendant LIKE 'P%'),
        q AS (SELECT 'P' || p_partkey AS a, 'P' || (p_partkey + 7) AS b FROM part), m AS (SELECT q.a, q.b, min(x.s + y.s) AS d FROM q JOIN a x ON x.node = q.a JOIN a y ON y.node = q.b AND y.ancestor = x.ancestor GROUP BY ALL)
        SELECT a, b, d AS distance FROM q LEFT JOIN m USING (a, b)""",
    "hierarchy_relation": _UPR + " SELECT sct_id AS a, hpo_id AS b, CASE WHEN c.ancestor IS NOT NULL THEN 'broader' ELSE 'lateral' END AS relation FROM p LEFT JOIN c ON c.ancestor = sct_id AND c.descendant = hpo_id",
    "related_candidates": _UPR + " SELECT x.hpo_id, x.sct_id AS broader, y.sct_id AS narrower FROM p x JOIN p y USING (hpo_id) JOIN c ON c.ancestor = x.sct_id AND c.descendant = y.sct_id",
    "target_collapse": _UPR + " SELECT x.hpo_id AS sct_id, x.sct_id AS broader, y.sct_id AS narrower FROM p x JOIN p y USING (hpo_id) JOIN c ON c.ancestor = x.sct_id AND c.descendant = y.sct_id",
    "cross_reversal": "SELECT 'N' || n_nationkey AS child, 'b' || n_nationkey AS child_sct, 'R' || n_regionkey AS parent, 'a' || n_regionkey AS parent_sct FROM nation",
    "cosine_pairs_all": """SELECT a.vec_id AS hpo_id, b.vec_id AS sct_id, 'embedding' AS attribute, round(round(least(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 1), 6), 4) AS confidence
        FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding, b.embedding) > 0.3""",
    "pair_phases": _R + f""", d AS (SELECT 'S' || s_suppkey AS sct_id, s_suppkey % 10 <> 0 AS ok FROM supplier UNION ALL SELECT 'N' || n_nationkey, true FROM nation),
        h AS (SELECT hpo_id, sct_id, bool_or(attribute = 'hpo_sct') AS x, bool_or(attribute = 'hpo_umls_sct') AS b, bool_or(attribute = 'umls_hpo_sct') AS s, bool_or(attribute = 'exact_lexical') AS l,
        bool_or(attribute = 'jaccard' AND confidence > 1 - 1e-6) AS j, bool_or(attribute = 'embedding' AND confidence > 1 - 1e-6) AS c FROM r GROUP BY ALL)
        SELECT hpo_id, sct_id, CASE WHEN NOT ok THEN '1' WHEN x AND l THEN '2' WHEN l THEN '2b' WHEN x AND (j OR c) THEN '2c' WHEN b AND (j OR c) THEN '3' WHEN s AND (j OR c) THEN '4'
        WHEN NOT (x OR b OR s) AND j AND c THEN '5' WHEN NOT (x OR b OR s) AND j THEN '6' END AS phase, x::INT + b::INT + s::INT AS refs, CASE WHEN l THEN 2 WHEN j THEN 1 ELSE 0 END AS lexical, c::INT AS cos1 FROM h JOIN d USING (sct_id)""",
    "evaluation_returned": _R + f""", n AS (SELECT count(*) AS n_pairs, count(*) FILTER ({_OK}) AS n_correct, count(DISTINCT hpo_id) AS n_hpo, count(DISTINCT hpo_id) FILTER ({_OK}) AS gold_hpo_hit,
        count(DISTINCT hpo_id) FILTER (hpo_id NOT IN (SELECT hpo_id FROM g)) AS hpo_not_in_gold, (SELECT count(*) FROM g) AS n_gold FROM f)
        SELECT *, {_ZERO.format("n_correct", "n_pairs")} AS precision, {_ZERO.format("n_correct", "n_gold")} AS recall FROM n""",
    "threshold_counts": _counts(REPORT_THRESHOLDS) + " SELECT * FROM z",
    "pr_curve": _counts(_SWEEP) + f""", o AS (SELECT threshold, n_pairs, n_correct, precision, {_ZERO.format("n_correct", "(SELECT count(*) FROM g)")} AS recall FROM z)
        SELECT *, {_ZERO.format("2 * precision * recall", "precision + recall")} AS f1 FROM o""",
    "method_table": _M + f""", u AS (SELECT *, list_min([{_RANK.format("y")} FOR y IN ms]) AS first FROM m), v AS (SELECT ok, first, len(ms) AS n, unnest(ms) AS a FROM u),
        w AS (SELECT a AS attribute, count(*) AS n_pairs, count(*) FILTER (ok) AS n_correct, count(*) FILTER (first = {_RANK.format("a")}) AS n_new, count(*) FILTER (ok AND n = 1) AS unique_correct FROM v GROUP BY 1)
        SELECT *, CAST(sum(n_new) OVER (ORDER BY {_RANK.format("attribute")}) AS BIGINT) AS n_cumulative FROM w""",
    "method_combinations": _M + " SELECT array_to_string(ms, ',') AS methods, count(*) AS n_pairs, count(*) FILTER (ok) AS n_correct, CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) AS precision FROM m GROUP BY 1",
    "pairwise_overlap": _R + ", d AS (SELECT DISTINCT hpo_id, sct_id, attribute AS a FROM r) SELECT x.a AS m1, y.a AS m2, count(*) AS n_pairs FROM d x JOIN d y USING (hpo_id, sct_id) WHERE x.a < y.a GROUP BY ALL",
    "method_agreement": _M + """, k AS (SELECT len(ms) AS k, count(*) AS exactly, count(*) FILTER (ok) AS exactly_correct FROM m GROUP BY 1)
        SELECT *, CAST(sum(exactly) OVER (ORDER BY k DESC) AS BIGINT) AS at_least, CAST(sum(exactly_correct) OVER (ORDER BY k DESC) AS BIGINT) AS at_least_correct FROM k""",
    "code_counts": _R + " SELECT validity, count(*) AS n_rows, count(DISTINCT (hpo_id, sct_id)) AS n_pairs, count(DISTINCT hpo_id) AS n_hpo FROM r GROUP BY validity",
    "step_outcomes": _R + f""", d AS (SELECT DISTINCT hpo_id, sct_id, step, {_OUT} AS o FROM r WHERE step IS NOT NULL) SELECT step, count(*) FILTER (o = 'accepted') AS accepted, count(*) FILTER (o = 'conflict') AS conflict,
        count(*) FILTER (o = 'review') AS review, count(*) FILTER (o = 'removed') AS removed FROM d GROUP BY step""",
    "coverage": _R + """ SELECT count(*) AS n_gold_hpo, count(*) FILTER (hpo_id IN (SELECT hpo_id FROM r WHERE attribute = 'jaccard')) AS n_generated, count(*) FILTER (hpo_id IN (SELECT hpo_id FROM f)) AS n_final FROM (SELECT DISTINCT hpo_id FROM g)""",
    "any_all_exact": _R + """, gg AS (SELECT hpo_id, list(sct_id) AS gs FROM g GROUP BY 1), ff AS (SELECT hpo_id, list(sct_id) AS fs FROM f GROUP BY 1), x AS (SELECT gs, coalesce(fs, []) AS fs FROM gg LEFT JOIN ff USING (hpo_id))
        SELECT count(*) AS n_hpo, count(*) FILTER (list_has_any(gs, fs)) AS n_any, count(*) FILTER (list_has_all(fs, gs)) AS n_all, count(*) FILTER (list_has_all(fs, gs) AND list_has_all(gs, fs)) AS n_exact FROM x""",
    "missed_diagnosis": _R + """, v AS (SELECT hpo_id, sct_id, max(validity) AS v, true AS made FROM r WHERE attribute <> 'hpo_sct' GROUP BY ALL), x AS (SELECT * FROM g ANTI JOIN f USING (hpo_id, sct_id))
        SELECT CASE WHEN made IS NULL THEN 'NEVER_GENERATED' WHEN v IS NULL THEN 'NOT_REACHED' WHEN v = 0 THEN 'DOMAIN_REJECTED' WHEN v BETWEEN 1 AND 7 THEN 'HIERARCHY_REVERSAL_LLM_REJECTED' WHEN v IN (8, 9) THEN 'FALLBACK_LLM_REJECTED' ELSE 'INCONSISTENCY' END AS reason, count(*) AS n_pairs
        FROM x LEFT JOIN v USING (hpo_id, sct_id) GROUP BY 1""",
    "nearest_target": _NEAR + " SELECT * FROM nt",
    "pipeline_flow": _R + f""", x AS (SELECT hpo_id, sct_id, max(validity) AS validity, max(step) AS step FROM r GROUP BY ALL), y AS (SELECT 'step ' || coalesce(step, 'none') AS s, coalesce({_OUT}, 'unreached') AS o, CASE WHEN (hpo_id, sct_id) IN (SELECT (hpo_id, sct_id) FROM f) THEN 'final' ELSE 'rejected' END AS z FROM x)
        SELECT source, target, count(*) AS n_pairs FROM (SELECT s AS source, o AS target FROM y UNION ALL SELECT o, z FROM y) GROUP BY ALL""",
    "pair_info": _INFO + " SELECT * FROM i",
    "accepted_without_gold": _INFO + " SELECT * FROM i WHERE (auto_accepted OR llm_accepted) AND hpo_id NOT IN (SELECT hpo_id FROM g)",
    "llm_disagreements": _INFO + " SELECT hpo_id, sct_id, CASE WHEN auto_accepted THEN 'auto_only' ELSE 'llm_only' END AS disagreement, in_gold, original_validity FROM i WHERE auto_accepted <> llm_accepted",
    "review_select": _R + f""", x AS (SELECT hpo_id, sct_id, max(validity) AS validity FROM r WHERE validity BETWEEN 1 AND 10 GROUP BY ALL), y AS (SELECT *, count(*) OVER (PARTITION BY hpo_id) AS n_sct FROM x)
        SELECT hpo_id, sct_id, validity, {_REASON} AS review_reason, n_sct, CASE WHEN n_sct = 1 THEN 1 ELSE 2 END AS llm_pass FROM y""",
    "review_parse": """WITH a AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'ACCEPT' ELSE 'REJECT' END AS d, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 3 <> 0 AS j FROM events),
        b AS (SELECT *, j AND coalesce(k BETWEEN 1 AND 5, false) AS ok FROM a)
        SELECT event_id, CASE WHEN ok THEN d ELSE 'REJECT' END AS llm_decision, CASE WHEN ok THEN k ELSE 1 END / 5.0::DOUBLE AS confidence, CASE WHEN ok THEN 'r' END AS llm_rationale, NOT ok AS unusable FROM b""",
    "gold_load": "SELECT * FROM (VALUES ('H1', 'SNOMEDCT_US:12345'), ('H2', 'SNOMEDCT_US:123456789012345678'), ('H5', 'SNOMEDCT_US:120000000'), ('H10', 'SNOMEDCT_US:7'), ('H11', 'SNOMEDCT_US:12')) t(hpo_id, sct_id)",
    "term_functions": "SELECT p_partkey, p_type AS tag, p_name AS term, lower(p_name || ' (' || p_type || ')') AS key, p_type IN ('disorder', 'finding', 'morphologic abnormality', '') AS ok FROM part",
}
