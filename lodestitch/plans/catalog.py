"""Registered queries and their SQL: terminologies built from the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.operators import candidates, mapping

from . import alignment, diagnostics, reports, searches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_name").alias("concept_id"), F.col("p_name").alias("term")).distinct()


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_name").alias("concept_id"), F.concat(F.lit(" "), F.upper("p_name")).alias("term")).distinct()


def exact_lexical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.exact_lexical(_source(spark, sf_dir), _target(spark, sf_dir))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    s = p.select(F.concat_ws("/", "p_brand", "p_name").alias("concept_id"), F.concat_ws(" ", "p_brand", "p_name").alias("term")).distinct()
    t = p.select(F.concat_ws("/", "p_brand", "p_type", "p_name").alias("concept_id"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("term")).distinct()
    return candidates.jaccard(s, t, 0.6).withColumn("confidence", F.round("confidence", 6))


def xref_direct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("concept_id"), F.col("l_partkey").alias("ref"))
    return candidates.xref_direct(refs, _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id")))


def xref_bridge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("concept_id"), F.col("c_nationkey").alias("ref"))
    return candidates.xref_bridge(refs, _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("concept_id"), F.col("n_regionkey").alias("ref")))


def xref_shared_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    left = o.select(F.col("o_orderkey").alias("concept_id"), F.col("o_custkey").alias("ref"))
    return candidates.xref_shared(left, li.select(F.col("l_orderkey").alias("concept_id"), F.col("l_suppkey").alias("ref")))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping rows: parts and their suppliers, the ship flag as the method, the discount as the confidence."""
    return _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("hpo_id"), F.col("l_suppkey").alias("sct_id"), F.col("l_returnflag").alias("attribute"), F.col("l_discount").alias("confidence"))


def metrics_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return mapping.metrics(rows.filter("confidence >= 0.05"), rows.filter("attribute = 'R'"))


QUERIES = alignment.QUERIES | diagnostics.QUERIES | searches.QUERIES | reports.QUERIES | {
    "exact_lexical_pairs": exact_lexical_pairs,
    "jaccard_pairs": jaccard_pairs,
    "xref_direct_pairs": xref_direct_pairs,
    "xref_bridge_pairs": xref_bridge_pairs,
    "xref_shared_pairs": xref_shared_pairs,
    "dedupe_max": lambda s, d: mapping.dedupe_max(_rows(s, d)),
    "pair_methods": lambda s, d: mapping.pair_methods(_rows(s, d)),
    "best_per_concept": lambda s, d: mapping.best_per_concept(_rows(s, d)),
    "constellations": lambda s, d: mapping.constellations(_rows(s, d)),
    "metrics_returned": metrics_returned,
}

_ROWS = "WITH r AS (SELECT l_partkey AS hpo_id, l_suppkey AS sct_id, l_returnflag AS attribute, l_discount AS confidence FROM lineitem) "
ORACLE_SQL = alignment.ORACLE_SQL | diagnostics.ORACLE_SQL | searches.ORACLE_SQL | reports.ORACLE_SQL | {
    "exact_lexical_pairs": """SELECT DISTINCT s.p_brand || '/' || s.p_name AS hpo_id, t.p_type || '/' || t.p_name AS sct_id,
        'exact_lexical' AS attribute, CAST(1 AS DOUBLE) AS confidence
        FROM (SELECT DISTINCT p_brand, p_name FROM part) s JOIN (SELECT DISTINCT p_type, p_name FROM part) t ON lower(s.p_name) = lower(trim(upper(t.p_name)))""",
    "jaccard_pairs": """WITH s AS (SELECT DISTINCT p_brand || '/' || p_name AS id, list_distinct(string_split(lower(p_brand || ' ' || p_name), ' ')) AS ts FROM part),
        t AS (SELECT DISTINCT p_brand || '/' || p_type || '/' || p_name AS id, list_distinct(string_split(lower(p_brand || ' ' || p_name || ' ' || p_type), ' ')) AS ts FROM part),
        su AS (SELECT id, len(ts) AS n, unnest(ts) AS w FROM s), tu AS (SELECT id, len(ts) AS n, unnest(ts) AS w FROM t),
        o AS (SELECT su.id AS hpo_id, tu.id AS sct_id, su.n AS a, tu.n AS b, count(*) AS i FROM su JOIN tu USING (w) GROUP BY ALL)
        SELECT hpo_id, sct_id, 'jaccard' AS attribute, round(CAST(i AS DOUBLE) / (a + b - i), 6) AS confidence FROM o WHERE CAST(i AS DOUBLE) / (a + b - i) > 0.6""",
    "xref_direct_pairs": """SELECT DISTINCT l_suppkey AS hpo_id, l_partkey AS sct_id, 'hpo_sct' AS attribute, CAST(1 AS DOUBLE) AS confidence
        FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)""",
    "xref_bridge_pairs": """SELECT DISTINCT c_custkey AS hpo_id, n_regionkey AS sct_id, 'hpo_umls_sct' AS attribute, CAST(1 AS DOUBLE) AS confidence
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "xref_shared_pairs": """SELECT DISTINCT o_custkey AS hpo_id, l_suppkey AS sct_id, 'umls_hpo_sct' AS attribute, CAST(1 AS DOUBLE) AS confidence
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "dedupe_max": _ROWS + "SELECT hpo_id, sct_id, max(confidence) AS confidence FROM r GROUP BY ALL",
    "pair_methods": _ROWS + """SELECT hpo_id, sct_id, string_agg(DISTINCT attribute, ',' ORDER BY attribute) AS methods,
        count(DISTINCT attribute) AS n_methods, max(confidence) AS best_conf FROM r GROUP BY hpo_id, sct_id""",
    "best_per_concept": _ROWS + """SELECT hpo_id, sct_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY hpo_id ORDER BY confidence DESC, sct_id) AS k FROM r) WHERE k = 1""",
    "constellations": _ROWS + """, p AS (SELECT DISTINCT hpo_id, sct_id FROM r),
        n AS (SELECT count(*) OVER (PARTITION BY hpo_id) AS a, count(*) OVER (PARTITION BY sct_id) AS b FROM p)
        SELECT CASE WHEN a = 1 AND b = 1 THEN '1:1' WHEN b = 1 THEN '1:n' WHEN a = 1 THEN 'n:1' ELSE 'm:n' END AS constellation, count(*) AS n_pairs FROM n GROUP BY 1""",
    "metrics_returned": _ROWS + """, p AS (SELECT DISTINCT hpo_id, sct_id FROM r WHERE confidence >= 0.05), g AS (SELECT DISTINCT hpo_id, sct_id FROM r WHERE attribute = 'R'),
        n AS (SELECT (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p JOIN g USING (hpo_id, sct_id)) AS n_correct),
        m AS (SELECT *, CAST(n_correct AS DOUBLE) / n_predicted AS precision, CAST(n_correct AS DOUBLE) / n_gold AS recall FROM n)
        SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM m""",
}
