"""Queries of the stage, review and error reports over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.constants import REVIEW_REASON, STAGES
from lodestitch.operators import diagnostics as x
from lodestitch.operators import review

from . import alignment as a


def _info(s: SparkSession, d: str) -> DataFrame:
    return a.QUERIES["pair_info"](s, d)


def xref_invalid_count(s: SparkSession, d: str) -> DataFrame:
    """Parts of the order lines looked up among the suppliers."""
    refs = a._t(s, d, "lineitem").select(F.col("l_orderkey").alias("concept_id"), F.col("l_partkey").alias("ref"))
    return x.invalid_references(refs, a._t(s, d, "supplier").select(F.col("s_suppkey").alias("concept_id")))


def xref_asymmetry(s: SparkSession, d: str) -> DataFrame:
    """Supplier to part by discounted lines, against part to supplier by returned lines."""
    li = a._t(s, d, "lineitem").select(F.col("l_suppkey").alias("concept_id"), F.col("l_partkey").alias("ref"), "l_discount", "l_returnflag")
    return x.edge_asymmetry(li.filter("l_discount >= 0.05"), li.filter("l_returnflag = 'R'"))


def anchor_domains(s: SparkSession, d: str) -> DataFrame:
    """Suppliers of debt have a second label with a tag; a supplier's first label and those of the others have none."""
    sup = a._t(s, d, "supplier")
    labels = sup.select(a._id("S", "s_suppkey").alias("concept_id"), F.lit(0).alias("ord"), F.col("s_name").alias("value"))
    tagged = F.concat("s_name", F.lit(" (nation "), F.col("s_nationkey").cast("string"), F.lit(")"))
    labels = labels.unionByName(sup.filter("s_acctbal < 0").select(a._id("S", "s_suppkey").alias("concept_id"), F.lit(1).alias("ord"), tagged.alias("value")))
    tagged = F.concat("n_name", F.lit(" (region "), F.col("n_regionkey").cast("string"), F.lit(")"))
    labels = labels.unionByName(a._t(s, d, "nation").select(a._id("N", "n_nationkey").alias("concept_id"), F.lit(0).alias("ord"), tagged.alias("value")))
    return x.anchor_domains(a.final(s, d), labels)


def methods_union(s: SparkSession, d: str) -> DataFrame:
    r = a.rows(s, d)
    return x.union_methods(*(r.filter(F.col("attribute") == m) for m in a.METHODS))


QUERIES = {
    "xref_invalid_count": xref_invalid_count,
    "xref_asymmetry": xref_asymmetry,
    "anchor_domains": anchor_domains,
    "methods_union": methods_union,
    "tied_concepts": lambda s, d: x.tied_concepts(a.rows(s, d)),
    "final_pairs": lambda s, d: x.final_pairs(_info(s, d)),
    "final_rows": lambda s, d: x.keep_pairs(a.rows(s, d), a.final(s, d)).select("hpo_id", "sct_id", "attribute", "confidence"),
    "stage_comparison": lambda s, d: x.stage_comparison(_info(s, d), a.gold(s, d)),
    "review_reasons": lambda s, d: x.review_reasons(_info(s, d), a.gold(s, d)),
    "review_evaluations": lambda s, d: x.review_evaluations(_info(s, d), review.select_pairs(a.rows(s, d)), a.gold(s, d)),
    "reversal_quality": lambda s, d: x.reversal_quality(_info(s, d)),
    "lost_gold": lambda s, d: x.lost_gold(_info(s, d)),
    "review_false_positives": lambda s, d: x.review_false_positives(_info(s, d)),
    "error_categories": lambda s, d: x.error_categories(_info(s, d), a.gold(s, d)),
    "most_targets": lambda s, d: x.most_targets(_info(s, d)),
    "final_examples": lambda s, d: x.examples(x.final_pairs(_info(s, d))),
    "top_combinations": lambda s, d: x.top_combinations(a.rows(s, d), a.gold(s, d)),
    "near_miss": lambda s, d: x.near_miss(a.QUERIES["nearest_target"](s, d), a.gold(s, d)),
}

_F = "(auto_accepted OR llm_accepted)"
_SHARE = a._ZERO
_PRF = f"{_SHARE.format('n_correct', 'n_pairs')} AS precision, {_SHARE.format('n_correct', 'n_gold')} AS recall"
_F1 = _SHARE.format("2 * precision * recall", "precision + recall") + " AS f1"
_NG = "(SELECT count(*) FROM g) AS n_gold"
_HELD = dict(zip(STAGES, ("true", "original_validity BETWEEN 1 AND 10", "auto_accepted", "llm_accepted", _F), strict=True))
_PASSES = {"before": "auto_accepted", "pass 1": "llm_accepted AND llm_pass = 1", "pass 2": "llm_accepted AND llm_pass = 2", "llm": "llm_accepted", "final": _F}
_CODES = ", ".join(f"({c}, '{r}')" for c, r in REVIEW_REASON.items())

ORACLE_SQL = {
    "xref_invalid_count": """SELECT count(*) AS n_references, count(*) FILTER (l_partkey NOT IN (SELECT s_suppkey FROM supplier)) AS n_invalid,
        count(DISTINCT l_orderkey) FILTER (l_partkey NOT IN (SELECT s_suppkey FROM supplier)) AS n_concepts FROM lineitem""",
    "xref_asymmetry": """WITH f AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_discount >= 0.05), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'),
        k AS (SELECT 'both' AS kind, * FROM (SELECT * FROM f INTERSECT SELECT * FROM b) UNION ALL SELECT 'forward', * FROM (SELECT * FROM f EXCEPT SELECT * FROM b) UNION ALL SELECT 'backward', * FROM (SELECT * FROM b EXCEPT SELECT * FROM f))
        SELECT kind, count(*) AS n_edges, count(DISTINCT l_suppkey) AS n_concepts FROM k GROUP BY kind""",
    "anchor_domains": a._R + """, t AS (SELECT 'S' || s_suppkey AS sct_id, 'nation ' || s_nationkey AS domain FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'N' || n_nationkey, 'region ' || n_regionkey FROM nation)
        SELECT coalesce(domain, 'unknown') AS domain, count(*) AS n_pairs FROM f LEFT JOIN t USING (sct_id) GROUP BY 1""",
    "methods_union": a._R + f" SELECT hpo_id, sct_id, attribute, confidence, CAST({a._RANK.format('attribute')} - 1 AS BIGINT) AS method_order FROM r",
    "tied_concepts": a._R + """, best AS (SELECT hpo_id, sct_id, max(confidence) AS c FROM r GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY hpo_id ORDER BY c DESC) AS n FROM best),
        t AS (SELECT hpo_id, count(*) AS n FROM k WHERE n = 1 GROUP BY 1) SELECT count(*) AS n_hpo, count(*) FILTER (n > 1) AS n_tied FROM t""",
    "final_pairs": a._INFO + f" SELECT hpo_id, sct_id FROM i WHERE {_F}",
    "final_rows": a._R + " SELECT hpo_id, sct_id, attribute, confidence FROM r WHERE (hpo_id, sct_id) IN (SELECT (hpo_id, sct_id) FROM f)",
    "stage_comparison": a._INFO + ", s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS stage, count(*) FILTER ({c}) AS n_pairs, count(*) FILTER ({c} AND in_gold) AS n_correct, {_NG}, count(*) AS n_all FROM i" for k, c in _HELD.items())
        + f"), t AS (SELECT *, {_PRF} FROM s) SELECT * EXCLUDE (n_all), {_F1}, {_SHARE.format('n_correct', 'n_all')} AS universe_share FROM t",
    "review_reasons": a._INFO + f""", c AS (SELECT validity, reason FROM (VALUES {_CODES}) v(validity, reason)), n AS (SELECT CAST(c.validity AS BIGINT) AS validity, reason, count(hpo_id) AS n_reviewed, count(*) FILTER (llm_accepted) AS n_pairs,
        count(*) FILTER (llm_accepted AND in_gold) AS n_correct, {_NG} FROM c LEFT JOIN i ON original_validity = c.validity GROUP BY c.validity, reason), t AS (SELECT *, {_PRF} FROM n)
        SELECT * RENAME (n_pairs AS n_accepted), {_F1}, {_SHARE.format('n_pairs', 'n_reviewed')} AS accepted_share FROM t""",
    "review_evaluations": a._INFO + """, x0 AS (SELECT hpo_id, sct_id FROM r WHERE validity BETWEEN 1 AND 10 GROUP BY ALL), y AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY hpo_id) = 1 THEN 1 ELSE 2 END AS llm_pass FROM x0),
        j AS (SELECT * FROM i LEFT JOIN y USING (hpo_id, sct_id)), s AS (""" + " UNION ALL ".join(
        f"SELECT '{k}' AS stage, count(*) FILTER ({c}) AS n_pairs, count(DISTINCT hpo_id) FILTER ({c}) AS n_hpo, count(*) FILTER ({c} AND in_gold) AS n_correct, {_NG} FROM j" for k, c in _PASSES.items())
        + f"), t AS (SELECT *, {_PRF} FROM s) SELECT *, {_F1} FROM t",
    "reversal_quality": a._INFO + """ SELECT count(*) AS n_pairs, count(*) FILTER (in_gold) AS n_correct, count(*) FILTER (llm_accepted) AS n_accepted, count(*) FILTER (llm_accepted AND in_gold) AS accepted_correct,
        count(*) FILTER (in_gold AND NOT llm_accepted) AS n_lost_gold FROM i WHERE original_validity BETWEEN 1 AND 7""",
    "lost_gold": a._INFO + " SELECT hpo_id, sct_id, original_validity FROM i WHERE original_validity BETWEEN 1 AND 7 AND in_gold AND NOT llm_accepted",
    "review_false_positives": a._INFO + " SELECT hpo_id, sct_id, original_validity FROM i WHERE llm_accepted AND NOT in_gold",
    "error_categories": a._INFO + f""", e AS (SELECT hpo_id, sct_id, i.hpo_id IS NOT NULL AS made, coalesce({_F}, false) AS fin, g.hpo_id IS NOT NULL AS gold FROM i FULL JOIN g USING (hpo_id, sct_id)),
        h AS (SELECT hpo_id, bool_or(made) AS made, bool_or(fin) AS fin, bool_or(gold) AS gold, coalesce(string_agg(sct_id, ',' ORDER BY sct_id) FILTER (fin AND gold), '') AS correct,
        coalesce(string_agg(sct_id, ',' ORDER BY sct_id) FILTER (gold AND NOT fin), '') AS missing, coalesce(string_agg(sct_id, ',' ORDER BY sct_id) FILTER (fin AND NOT gold), '') AS extra FROM e GROUP BY hpo_id)
        SELECT * FROM (SELECT hpo_id, CASE WHEN NOT gold AND fin THEN 'C' WHEN gold AND NOT made THEN 'A' WHEN gold AND NOT fin THEN 'B' WHEN gold AND correct = '' THEN 'D_WRONG' WHEN gold AND missing <> '' THEN 'D_PARTIAL' END AS category,
        correct, missing, extra FROM h) WHERE category IS NOT NULL""",
    "most_targets": a._INFO + f" SELECT hpo_id, count(*) AS n_targets, count(*) FILTER (in_gold) AS n_correct FROM i WHERE {_F} GROUP BY hpo_id HAVING count(*) > 1 ORDER BY n_targets DESC, hpo_id LIMIT 10",
    "final_examples": a._INFO + f" SELECT hpo_id, sct_id, greatest((SELECT count(*) FROM i WHERE {_F}) - 10, 0) AS n_more FROM i WHERE {_F} ORDER BY hpo_id, sct_id LIMIT 10",
    "top_combinations": a.ORACLE_SQL["method_combinations"] + " ORDER BY n_correct DESC, n_pairs DESC, methods LIMIT 10",
    "near_miss": a._NEAR + ", m AS (SELECT * FROM nt WHERE hpo_id IN (SELECT hpo_id FROM g)) SELECT count(*) AS n_pairs, " + ", ".join(f"{_SHARE.format(f'count(*) FILTER (gold_distance <= {k})', 'count(*)')} AS within_{k}" for k in (0, 1, 2)) + " FROM m",
}
