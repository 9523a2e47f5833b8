"""Queries of the durable review store, searched distances, pruned cosine search and token normaliser, with their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestitch.functions.storage import Scratch
from lodestitch.functions.tokens import TokenNormalizer
from lodestitch.operators import candidates, distances, embedding, review
from lodestitch.operators.answers import AnswerStore

from . import alignment as a


def _by_number(rationale: str) -> Callable[[list[str]], list[str]]:
    """A model that decides by the number in an event's JSON and says in which run it was asked."""

    def model(prompts: list[str]) -> list[str]:
        numbers = [json.loads(p.split(" ", 1)[1])["k"] for p in prompts]
        return [json.dumps({"rationale": rationale, "decision": "ACCEPT" if k % 2 == 0 else "REJECT", "confidence": k % 5 + 1}) for k in numbers]

    return model


def review_resume(s: SparkSession, d: str) -> DataFrame:
    """All events reviewed in two runs over one store: purchases first, then all, of which only the others are asked."""
    asked = a._t(s, d, "events").select("event_id", "event_type", F.concat_ws(" ", "event_type", "props").alias("prompt"))
    path = f"{Scratch(s, 'review').folder.path}/answers"
    AnswerStore(s, path, {"model": "by number"}).fill(asked.filter("event_type = 'purchase'"), _by_number("first"))
    store = AnswerStore(s, path, {"model": "by number"})
    store.fill(asked, _by_number("second"))
    return review.parse_pair(store.attach(asked).select("event_id", "answer"))


def distance_cyclic(s: SparkSession, d: str) -> DataFrame:
    """Suppliers in a hierarchy with two parents each and cycles; each against another one."""
    sup = a._t(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    n = F.lit(sup.count())
    both = F.array((F.col("k") * 7 + 3) % n, F.floor(F.col("k") / 2))
    return distances.search(sup.select(F.col("k").alias("a"), ((F.col("k") * 5 + 1) % n).alias("b")), sup.select(F.explode(both).alias("parent"), F.col("k").alias("child")))


def term_tokens(s: SparkSession, d: str) -> DataFrame:
    """Tokens of a phrase about each part."""
    phrase = F.concat(F.lit("The "), "p_name", F.lit("s of "), "p_type")
    return TokenNormalizer().normalize(a._t(s, d, "part").select("p_partkey", phrase.alias("term"))).select("p_partkey", F.array_join("tokens", " ").alias("tokens"))


def jaccard_normalised(s: SparkSession, d: str) -> DataFrame:
    """Parts by brand against plural names in capitals after a protected word."""
    p = a._t(s, d, "part")
    source = p.select(F.concat_ws("/", "p_brand", "p_name").alias("concept_id"), F.concat(F.lit("The "), "p_name", F.lit(" of "), "p_brand").alias("term"))
    target = p.select(F.concat_ws("/", "p_type", "p_name").alias("concept_id"), F.concat(F.lit("WITHOUT "), F.upper("p_name"), F.lit("S")).alias("term"))
    return candidates.jaccard(source.distinct(), target.distinct(), 0.35, TokenNormalizer()).withColumn("confidence", F.round("confidence", 6))


def cosine_skipped(s: SparkSession, d: str) -> DataFrame:
    """Share of block pairs that the search of near-equal embeddings skips."""
    v = a._t(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return embedding.skipped(v, threshold=0.9)


QUERIES = {"review_resume": review_resume, "distance_cyclic": distance_cyclic, "term_tokens": term_tokens, "jaccard_normalised": jaccard_normalised, "cosine_skipped": cosine_skipped}

ORACLE_SQL = {
    "review_resume": """WITH k AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
        SELECT event_id, CASE WHEN k % 2 = 0 THEN 'ACCEPT' ELSE 'REJECT' END AS llm_decision, (k % 5 + 1) / 5.0::DOUBLE AS confidence, CASE WHEN event_type = 'purchase' THEN 'first' ELSE 'second' END AS llm_rationale, false AS unusable FROM k""",
    "distance_cyclic": """WITH RECURSIVE n AS (SELECT count(*) AS n FROM supplier), e AS (SELECT s_suppkey AS child, (s_suppkey * 7 + 3) % n AS parent FROM supplier, n UNION SELECT s_suppkey, s_suppkey // 2 FROM supplier),
        w AS (SELECT s_suppkey AS start, s_suppkey AS node, 0 AS s FROM supplier UNION SELECT w.start, e.parent, w.s + 1 FROM w JOIN e ON e.child = w.node WHERE w.s < 20), c AS (SELECT start, node, min(s) AS s FROM w GROUP BY ALL),
        p AS (SELECT s_suppkey AS a, (s_suppkey * 5 + 1) % n AS b FROM supplier, n)
        SELECT a, b, CAST(CASE WHEN a = b THEN 0 ELSE min(x.s + y.s) END AS BIGINT) AS distance FROM p JOIN c x ON x.start = a LEFT JOIN c y ON y.start = b AND y.node = x.node GROUP BY a, b""",
    "term_tokens": "SELECT p_partkey, replace(replace(lower(p_name || ' ' || p_type), 'large', 'larg'), 'economy', 'economi') AS tokens FROM part",
    "jaccard_normalised": """WITH s AS (SELECT DISTINCT p_brand || '/' || p_name AS id, list_distinct(list_concat(string_split(p_name, ' '), ['brand', string_split(p_brand, '#')[2]])) AS ts FROM part),
        t AS (SELECT DISTINCT p_type || '/' || p_name AS id, list_distinct(list_concat(string_split(p_name, ' '), ['without'])) AS ts FROM part),
        su AS (SELECT id, len(ts) AS n, unnest(ts) AS w FROM s), tu AS (SELECT id, len(ts) AS n, unnest(ts) AS w FROM t),
        o AS (SELECT su.id AS hpo_id, tu.id AS sct_id, su.n AS a, tu.n AS b, count(*) AS i FROM su JOIN tu USING (w) GROUP BY ALL)
        SELECT hpo_id, sct_id, 'jaccard' AS attribute, round(CAST(i AS DOUBLE) / (a + b - i), 6) AS confidence FROM o WHERE CAST(i AS DOUBLE) / (a + b - i) > 0.35""",
}
