"""What moves between tasks doesn't grow with products of the input or with lists that are shown in part."""

import random
from contextlib import contextmanager

from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestitch.functions.storage import Scratch
from lodestitch.operators import distances, hierarchy, reports, review
from lodestitch.plans import alignment

SF = "/root/testdata/sf0.001"


@contextmanager
def shuffled(spark, most):
    """Fails if more than ``most`` bytes are shuffled inside; no join is broadcast."""
    written = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written()
        yield
        assert written() - before <= most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_prompts_carry_no_children_lists(spark):
    children = [(f"c{random.Random(i).getrandbits(64)}",) for i in range(4000)]
    edges = spark.createDataFrame([("s1", c) for (c,) in children], "parent string, child string")
    label = lambda ids: spark.createDataFrame([(i, "label", f"label {i}") for i in ids], "concept_id string, attribute string, value string")
    chosen = review.select_pairs(spark.createDataFrame([(f"h{i}", t, 10) for i in range(500) for t in ("s1", "gone")], "hpo_id string, sct_id string, validity int"))
    target = review.describe(label(["s1", *[c for (c,) in children]]), edges)
    reach = spark.createDataFrame([], "ancestor string, descendant string, min_steps long")
    with shuffled(spark, 2_000_000):
        got = {r.hpo_id: r.prompt for r in review.prompts(chosen, review.describe(label([f"h{i}" for i in range(1, 500)]), edges), target, reach).collect()}
    assert len(got) == 500 and all("(10 of 4000 shown)" in p and '* ID: gone\n* Term: "None"' in p for p in got.values())
    assert got["h1"].startswith('* Label: "label h1"\n') and got["h0"].startswith('* Label: "None"\n')


def test_report_of_conditions(spark):
    r = alignment.rows(spark, SF)
    jaccard = F.col("attribute") == "jaccard"
    with shuffled(spark, 600_000):
        found = reports.report(r, F.col("gold"), jaccard)
    plain = reports.report(r, r.filter("gold").select("hpo_id", "sct_id"), r.filter(jaccard).select("hpo_id", "sct_id"))
    assert all(sorted(map(tuple, found[n].collect())) == sorted(map(tuple, plain[n].collect())) for n in plain)


def test_pairs_are_dealt_before_they_are_added_up(spark):
    """No map of all pairs that a task reads, and one exchange."""
    plan = reports.pair_table(alignment.rows(spark, SF), F.col("gold"), F.col("attribute") == "jaccard")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("Aggregate") < plan.index("Exchange hashpartitioning")


def test_kinds_of_nulls_keep_their_sets(spark):
    rows = spark.createDataFrame([("h1", "a", "jaccard", 0.8, None, None), ("h1", "b", "embedding", None, 8, None), ("h2", "a", "hpo_sct", 1.0, None, "2"), (None, "a", None, None, 10, "2")], "hpo_id string, sct_id string, attribute string, confidence double, validity int, step string")
    found = reports.report(rows, F.lit(False), F.lit(False))
    assert {(x.stage, x.n_pairs, x.n_hpo) for x in found["stages"].collect()} == {("generated", 4, 3), ("filtered", 2, 2), ("auto", 1, 1), ("llm", 0, 0), ("final", 1, 1)}
    assert {(x.validity, x.n_pairs, x.n_hpo) for x in found["codes"].collect() if x.n_pairs} == {("8", 1, 1), ("10", 1, 1), ("none", 2, 2)}


def test_gold_pairs_that_were_not_made_count_as_gold_only(spark):
    rows = spark.createDataFrame([("h1", "a", "jaccard", 0.8, 10, "2"), ("h1", "a", "jaccard", 0.9, 8, None), (None, "a", "embedding", 1.0, None, None)], "hpo_id string, sct_id string, attribute string, confidence double, validity int, step string")
    pairs = spark.createDataFrame([("h1", "a"), ("h2", "b"), ("h2", "b"), (None, "a")], "hpo_id string, sct_id string")
    found = reports.report(rows, pairs, pairs.filter("hpo_id = 'h2'"))
    assert {tuple(x) for x in found["summary"].collect()} == {("gold", 3), ("universe", 2), ("auto", 1), ("llm", 0), ("final", 1)}
    assert found["best_f1"].filter("pool = 'jaccard'").first().threshold == 0.9
    assert {(x.stage, x.n_hpo, x.n_correct) for x in found["stages"].collect()} >= {("generated", 2, 1), ("auto", 1, 1)}


def test_gold_distances_without_products(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame([(str(rng.randrange(i)), str(i)) for i in range(1, 60)] + [("3", "1"), ("1", "3"), ("20", "2"), ("7", "40")], "parent string, child string")
    pair = "hpo_id string, sct_id string"
    some = lambda n: spark.createDataFrame(sorted({(f"h{rng.randrange(5)}", str(rng.randrange(62))) for _ in range(n)}), pair)
    p, g = some(90), some(30)
    met = p.join(g.withColumnRenamed("sct_id", "g"), "hpo_id")
    d = {(r.a, r.b): r.distance for r in distances.search(met.select(F.col("sct_id").alias("a"), F.col("g").alias("b")), edges).collect()}
    want = {}
    for r in met.collect():
        x = d[r.sct_id, r.g]
        old = want.setdefault((r.hpo_id, r.sct_id), (None, None))
        if x is not None and (old[0] is None or (x, r.g) < old):
            want[r.hpo_id, r.sct_id] = (x, r.g)
    assert {(r.hpo_id, r.sct_id): (r.gold_distance, r.nearest_gold_sct) for r in reports.gold_distances(p, g, edges).collect()} == want
    wide = spark.range(1500).select(F.lit("h").alias("hpo_id"), F.col("id").cast("string").alias("sct_id"))
    tree = spark.range(3000).select(F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("parent"), F.col("id").cast("string").alias("child"))
    gold = spark.range(1500, 3000).select(F.lit("h").alias("hpo_id"), F.col("id").cast("string").alias("sct_id"))
    with shuffled(spark, 3_000_000):
        near = reports.gold_distances(wide, gold, tree)
        assert near.filter("gold_distance = 2 AND gold_relation = 'lateral'").count() == 1500


def test_leaves_settle_a_round_earlier(spark):
    edges = spark.createDataFrame([("r", "m0"), ("r", "m1"), ("r", "m2")] + [(f"m{i % 3}", str(i)) for i in range(30)], "parent string, child string")
    pairs = [(str(i), str(i + 1)) for i in range(29)] + [("0", "3"), ("m0", "0"), ("5", "r"), ("6", "gone"), ("7", "7")]
    trace = []
    got = {(r.a, r.b): r.distance for r in distances.search(spark.createDataFrame(pairs, "a string, b string"), edges, trace).collect()}
    assert got == {p: 4 for p in pairs[:29]} | dict(zip(pairs[29:], (2, 1, 2, None, 0), strict=True))
    assert len(trace) == 2


def test_relations_deal_pairs_and_closure_once(spark):
    reach = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "c")], "ancestor string, descendant string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("c", "c"), ("b", "c"), ("b", "c"), (None, "a"), ("a", None)], "a string, b string")
    found = hierarchy.relation(pairs, reach)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(str, found.collect())) == sorted(map(str, [Row(a=a, b=b, relation=k) for a, b, k in (
        ("a", "b", "broader"), ("b", "a", "broader"), ("a", "c", "broader"), ("c", "a", "narrower"), ("c", "c", "equal"), ("b", "c", "lateral"), (None, "a", "lateral"), ("a", None, "lateral"))]))


def test_closure_climbs_without_the_leaves(spark):
    edges = spark.range(20_000).select(F.concat(F.lit("m"), (F.col("id") % 5).cast("string")).alias("parent"), F.concat(F.lit("leaf of the tree "), F.col("id").cast("string")).alias("child"))
    tree = edges.unionByName(spark.createDataFrame([("r", f"m{i}") for i in range(5)] + [("m3", "r")], "parent string, child string"))
    with shuffled(spark, 3_000_000):
        assert hierarchy.closure(tree).groupBy("min_steps").count().orderBy("min_steps").collect() == [(1, 20_006), (2, 20_006), (3, 16_000)]


def test_tables_kept_one_after_another_have_their_own_names(spark):
    scratch = Scratch(spark, "names")
    assert sorted(scratch.keep(spark.range(i), "t").count() for i in range(1, 5)) == [1, 2, 3, 4]
    assert len(scratch.folder.names()) == 4
