"""How quality filters interact: inclusion and exclusion over joint failures."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Bit sets of filters, the empty one first.
SETS = range(1 << len(FILTERS))
COUNTS = ("j", "j_good", "j_toxic")
_WORD_BREAK = r"[\x20\x09-\x0D]+"


def text_failures(text: str = "text") -> list[Column]:
    """Failures A to D of a text: few words, few distinct words, many capitals, symbols."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, _WORD_BREAK), lambda w: w != "")
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * capitals > 5 * F.length(t), t.rlike(r"[#$%&*|]")]


def failing_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, a, b, c, d, e, good, toxic, n): how many documents fail which filters, summed as far as rows agree.

    Documents travel as flags and a SHA-256 of their text. Rows are counted by text, part and labels before the
    texts' smallest ids are looked up, so a group of copies, however large, is a few rows by then.
    """
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flags = [x.alias(c) for x, c in zip(text_failures(), "abcd", strict=True)]
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), *flags)
    d = d.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    keys = ["part", "a", "b", "c", "d", "good", "toxic"]
    each = d.groupBy("digest", *keys, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    alike = each.groupBy("digest", *keys).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    least = alike.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    both = alike.join(least, "digest")
    spared = F.col("n_null") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    rows = F.array(F.struct(F.lit(False).alias("e"), spared.alias("n")), F.struct(F.lit(True).alias("e"), (F.col("n") - spared).alias("n")))
    return both.select(*keys, F.inline(rows)).filter("n > 0").groupBy(*keys, "e").agg(F.sum("n").alias("n"))


def joint_failures(failing: DataFrame) -> DataFrame:
    """(part, j, j_good, j_toxic): arrays of the documents that fail all filters of each set, as sums of flag products."""
    pattern = F.lit(0)
    for i, c in enumerate(FILTERS.lower()):
        pattern = pattern + F.col(c).cast("int") * (1 << i)
    every = F.sequence(F.lit(0), F.lit(len(SETS) - 1))
    held = failing.select("part", "n", "good", "toxic", pattern.alias("pattern")).select("part", "n", "good", "toxic", F.explode(F.filter(every, lambda s: s.bitwiseAND(F.col("pattern")) == s)).alias("s"))
    n = F.col("n")
    sums = held.groupBy("part", "s").agg(F.sum(n).alias("j"), F.sum(n * F.col("good").cast("long")).alias("j_good"), F.sum(n * F.col("toxic").cast("long")).alias("j_toxic"))
    by_set = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("j", "j_good", "j_toxic")))).alias("m"))

    def dense(c: str) -> Column:
        return F.transform(every, lambda s: F.coalesce(F.try_element_at("m", s).getField(c), F.lit(0).cast("long"))).alias(c)

    return by_set.select("part", *map(dense, COUNTS))


def _total(j: str, sets: Column, factor: Callable[[Column], Column]) -> Column:
    """Sum of the joint failures ``j`` over ``sets``, each times its factor."""
    return F.aggregate(sets, F.lit(0).cast("long"), lambda total, s: total + factor(s) * F.get(F.col(j), s))


def inverted(joint: DataFrame) -> DataFrame:
    """Adds, by Möbius inversion over the sets: survivors of each set of filters, and for each filter the documents
    that fail it alone and 120 times its Shapley value, whose Harsanyi dividends are the signed joint failures."""
    every, single = (F.array(*[F.lit(s) for s in x]) for x in (SETS, [1 << i for i in range(len(FILTERS))]))
    sign = lambda s: F.when(F.bit_count(s) % 2 == 0, 1).otherwise(-1)
    below = lambda p: F.filter(every, lambda s: s.bitwiseAND(p) == s)
    holding = lambda i: F.filter(every, lambda s: s.bitwiseAND(i) == i)

    def survivors(j: str) -> Column:
        return F.transform(every, lambda p: _total(j, below(p), sign))

    alone = F.transform(single, lambda i: _total("j", holding(i), lambda s: -sign(s)))
    shapley = F.transform(single, lambda i: _total("j", holding(i), lambda s: -sign(s) * (F.lit(120) / F.bit_count(s)).cast("int")))
    return joint.withColumns({f"left_{j}": survivors(j) for j in COUNTS} | {"alone": alone, "shapley_120": shapley})


def _steps() -> Column:
    """The 600 steps of all orders, as a constant: name, step, the filter and the sets before and after it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            rows.append({"filter_order": "".join(FILTERS[k] for k in order), "step": step, "i": i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,i:int,before:int,after:int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (``source``) and per step of each of the 120 orders of the filters A to E: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley, as counts.

    Only the 32 joint-failure counts of a part are summed over documents; all else follows from them. Null texts are
    empty and equal to empty ones, a null source is the part "". A document fails E if its text stands under a
    smaller id; rows that repeat the smallest id do not, and neither do null ids, which make no other row fail.
    Several labels of an id count as good or toxic if one of them says so; documents without a label are neither. An
    empty table has no parts and gives no rows. Other columns are not read.
    """
    c = lambda j, s: F.col(j)[F.col(s)]
    rows = inverted(joint_failures(failing_rows(docs, labels))).select("*", F.inline(_steps()))
    lost = {name: c(f"left_{j}", "before") - c(f"left_{j}", "after") for name, j in (("removed", "j"), ("good_lost", "j_good"), ("toxic_lost", "j_toxic"))}
    own = F.col("j")[F.col("after") - F.col("before")]
    return rows.select(
        "part", "filter_order", "step", c("left_j", "after").alias("kept"), lost["removed"].alias("removed"), (own - lost["removed"]).alias("redundant"),
        F.col("alone")[F.col("i")].alias("unique_fails"), lost["good_lost"].alias("good_lost"), lost["toxic_lost"].alias("toxic_lost"), F.col("shapley_120")[F.col("i")].alias("shapley"),
    )


#: The audit by plain counting, for DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM documents d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
), flags AS (
  SELECT part, good, toxic, len(w) < 50 AS fa, 100 * len(list_distinct(w)) < 65 * len(w) AS fb, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS fc,
    regexp_matches(t, '[#$%&*|]') AS fd, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS fe
  FROM d
), patterns AS (
  SELECT part, good, toxic, [fa, fb, fc, fd, fe] AS f, count(*) AS n FROM flags GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 3, 4, 5]) AS k
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS (SELECT filter_order, o, unnest([1, 2, 3, 4, 5]) AS step FROM orders
), judged AS (
  SELECT part, good, toxic, n, filter_order, step, o[step] AS i, f[o[step]] AS fails,
    list_bool_or(list_transform(o[1:step - 1], lambda k: f[k])) IS TRUE AS gone, list_sum(list_transform(f, lambda x: x::int)) AS n_fails
  FROM patterns, steps
), rows AS (
  SELECT part, filter_order, step, i,
    sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, i
)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost,
  toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, i))::bigint AS shapley
FROM rows
"""
