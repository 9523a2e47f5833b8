"""The report's one scan, its agreement with the single tables, and structure in arbitrary sets."""

import pytest

from lodestitch.operators import distances, evaluation, goldcheck, reports, review
from lodestitch.plans import alignment
from lodestitch.plans import reports as plans

SF = "/root/testdata/sf0.001"


def executions(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_all_tables_from_one_scan(spark):
    r, g = alignment.rows(spark, SF), alignment.gold(spark, SF)
    before = executions(spark)
    found = reports.report(r, g, r.filter("attribute = 'jaccard'"))
    # One to write the pairs with what was observed, one to read them for all sets.
    assert executions(spark) - before <= 2
    assert len(found) == 14 and all(df.count() for df in found.values())
    agreement = {tuple(x) for x in evaluation.agreement(r, g).collect()}
    assert agreement == {tuple(x) for x in found["agreement"].collect() if x.exactly or x.at_least}
    assert {(x.threshold, x.n_pairs, x.n_correct) for x in evaluation.threshold_counts(r.filter("attribute = 'jaccard'"), g).collect()} == {(x.threshold, x.n_pairs, x.n_correct) for x in found["thresholds"].filter("pool = 'jaccard'").collect()}
    flow = {(x.source, x.target): x.n_pairs for x in found["flow"].collect()}
    universe = {x.name: x.n_pairs for x in found["summary"].collect()}["universe"]
    assert sum(n for (s, _), n in flow.items() if s.startswith("step")) == universe == sum(n for (_, t), n in flow.items() if t in ("final", "rejected"))


def test_report_of_nothing(spark):
    rows = spark.createDataFrame([], "hpo_id string, sct_id string, attribute string, confidence double, validity int, step string")
    found = reports.report(rows, rows, rows)
    assert found["sweeps"].count() == found["best_f1"].count() == found["thresholds"].count() == found["flow"].count() == 0
    assert {x.n_pairs for x in found["stages"].collect()} == {0} and found["filter_steps"].count() == 10


def test_related_pairs_of_any_sets(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("x", "y"), ("y", "x")], "parent string, child string")
    members = spark.createDataFrame([(1, i) for i in "abcxy"] + [(2, i) for i in "cdq"] + [(3, "a"), (3, "c"), (3, "c")], "g int, id string")
    got = {tuple(r) for r in distances.related_pairs(members, distances.climb(members.select("id"), edges), ["g"]).collect()}
    assert got == {(1, "a", "b"), (1, "a", "c"), (1, "b", "c"), (1, "x", "y"), (3, "a", "c")}


def test_structure_of_two_sets(spark):
    pairs = lambda *x: spark.createDataFrame(list(x), "hpo_id string, sct_id string")
    source = spark.createDataFrame([("h1", "h2"), ("h2", "h3")], "parent string, child string")
    target = spark.createDataFrame([("s1", "s2"), ("s2", "s3")], "parent string, child string")
    found = reports.structure({"final": pairs(("h1", "s3"), ("h3", "s1"), ("h3", "s2"), ("h2", "s2")), "gold": pairs(("h1", "s1"))}, source, target)
    assert {tuple(r) for r in found["source_collapse"].collect()} == {("final", "h3", "s1", "s2")}
    assert {tuple(r) for r in found["target_collapse"].collect()} == {("final", "s2", "h2", "h3")}
    assert {tuple(r) for r in found["reversals"].collect()} == {("final", "h1", "h3", "s3", "s1"), ("final", "h1", "h3", "s3", "s2"), ("final", "h1", "h2", "s3", "s2"), ("final", "h2", "h3", "s2", "s1")}
    assert {tuple(r) for r in found["counts"].collect()} == {("final", "source_collapse", 1, 1), ("final", "target_collapse", 1, 1), ("final", "reversals", 4, 2)}


def test_distances_of_unknown_targets(spark):
    pairs = lambda *x: spark.createDataFrame(list(x), "hpo_id string, sct_id string")
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("b", "c")], "parent string, child string")
    known = spark.createDataFrame([("r",), ("a",), ("b",), ("c",)], "concept_id string")
    near = reports.gold_distances(pairs(("1", "a"), ("2", "b"), ("3", "gone"), ("4", "a"), ("5", "c")), pairs(("1", "b"), ("1", "c"), ("2", "c"), ("3", "gone"), ("5", "b")), edges, known)
    got = {tuple(r) for r in near.collect()}
    assert got == {("1", "a", 2, "b", "lateral"), ("2", "b", 1, "c", "broader"), ("3", "gone", None, None, "gold_not_in_sct"), ("5", "c", 1, "b", "narrower")}
    table = {(r.bucket): (r.n_pairs, r.share, r.cumulative, r.broader, r.narrower, r["lateral"]) for r in reports.distance_table(near, {"all": near}).collect()}
    assert table["1"] == (2, 0.5, 0.5, 1, 1, 0) and table["5+"] == (0, 0.0, 0.75, 0, 0, 0) and table["gold_not_in_sct"] == (1, 0.25, None, 0, 0, 0)


def test_gold_check_reads_strictly(spark, tmp_path):
    gold = spark.createDataFrame([("h1", "s1"), ("h2", "s1"), ("h2", "s2"), ("h3", "s9"), ("h9", "s9")], "hpo_id string, sct_id string")
    concepts = lambda ids: spark.createDataFrame([(i, "label", f"label {i}") for i in ids] + [(ids[0], "label", "also")], "concept_id string, attribute string, value string")
    edges = spark.createDataFrame([("s1", "s2")], "parent string, child string")
    answers = {"h1": '{"decision": " accept ", "confidence": "4", "rationale": "x"}', "h2": '{"mappings": [{"sct_id": "s1", "decision": "maybe", "confidence": 3}, {"sct_id": "s2", "decision": "ACCEPT", "confidence": 5}]}'}
    model = lambda ps: [next(a for h, a in answers.items() if f"label {h}" in p) for p in ps]
    out = goldcheck.check(gold, concepts(["h1", "h2", "h3"]), concepts(["s1", "s2"]), edges, model, "s", str(tmp_path / "store"))
    got = {(r.hpo_id, r.sct_id): (r.hpo_label, r.sct_label, r.status, r.n_sct, r.llm_pass, r.llm_decision, r.confidence) for r in out.collect()}
    assert got == {
        ("h1", "s1"): ("also; label h1", "also; label s1", "CHECKED", 1, 1, "ACCEPT", 0.8), ("h2", "s1"): ("label h2", "also; label s1", "CHECKED", 2, 2, "REJECT", 0.2), ("h2", "s2"): ("label h2", "label s2", "CHECKED", 2, 2, "ACCEPT", 1.0),
        ("h3", "s9"): ("label h3", "", "SCT_NOT_FOUND", None, None, None, None), ("h9", "s9"): ("", "", "HPO_NOT_FOUND", None, None, None, None),
    }
    asked = review.AnswerStore(spark, str(tmp_path / "store"), "s")
    assert asked.answers().count() == 2


def test_review_file_may_be_absent(spark):
    from lodestitch.sources import layout

    none = layout.read_optional(spark, "/gone", layout.REVIEW)
    details = plans._details(spark, SF)
    rows = reports.disagreements(details, none).collect()
    assert rows and all(r.llm_pass is None and r.llm_rationale is None for r in rows)
    assert [(r.disagreement, r.hpo_id, r.sct_id) for r in rows] == sorted((r.disagreement, r.hpo_id, r.sct_id) for r in rows)
    assert reports.without_gold(details).filter("gold_distance IS NOT NULL").count() == 0


@pytest.mark.parametrize("name", ["stages", "codes", "methods_final", "combinations"])
def test_scores_are_consistent(spark, name):
    for r in plans.tables(spark, SF)[name].collect():
        assert r.n_correct <= r.n_pairs and r.precision == (r.n_correct / r.n_pairs if r.n_pairs else 0)
