from lodestitch.operators import diagnostics as x


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def info(spark):
    rows = [
        ("h1", "a", 10, True, False, True), ("h1", "b", 0, False, False, False), ("h2", "a", 3, False, False, True), ("h3", "c", 9, False, True, False), ("h4", "d", 2, False, True, True),
        ("h4", "e", None, False, False, True), ("h5", "a", 10, True, True, False),
    ]
    return table(spark, rows, "hpo_id string, sct_id string, original_validity long, auto_accepted boolean, llm_accepted boolean, in_gold boolean")


def gold(spark):
    return table(spark, [("h1", "a"), ("h2", "a"), ("h4", "d"), ("h4", "e"), ("h5", "z"), ("h6", "q")], "hpo_id string, sct_id string")


def test_error_categories(spark):
    got = {tuple(r) for r in x.error_categories(info(spark), gold(spark)).collect()}
    assert got == {("h2", "B", "", "a", ""), ("h3", "C", "", "", "c"), ("h4", "D_PARTIAL", "d", "e", ""), ("h5", "D_WRONG", "", "z", "a"), ("h6", "A", "", "q", "")}


def test_stages_and_reversals(spark):
    got = {r.stage: (r.n_pairs, r.n_correct) for r in x.stage_comparison(info(spark), gold(spark)).collect()}
    assert got == {"generated": (7, 4), "filtered": (5, 3), "auto": (2, 1), "llm": (3, 1), "final": (4, 2)}
    assert tuple(x.reversal_quality(info(spark)).first()) == (2, 2, 1, 1, 1)
    assert [tuple(r) for r in x.lost_gold(info(spark)).collect()] == [("h2", "a", 3)]


def test_empty_tables_give_zero_rows_of_every_stage(spark):
    none = info(spark).limit(0)
    assert {(r.n_pairs, r.precision, r.f1) for r in x.stage_comparison(none, gold(spark).limit(0)).collect()} == {(0, 0.0, 0.0)}
    assert {r.n_reviewed for r in x.review_reasons(none, gold(spark)).collect()} == {0}
    assert x.error_categories(none, gold(spark).limit(0)).count() == 0


def test_references(spark):
    refs = table(spark, [("h1", "a"), ("h1", "zz"), ("h2", None), ("h1", "yy")], "concept_id string, ref string")
    assert tuple(x.invalid_references(refs, table(spark, [("a",), (None,)], "concept_id string")).first()) == (4, 3, 2)
    back = table(spark, [("h1", "a"), ("h3", "b"), ("h3", "b")], "concept_id string, ref string")
    assert {tuple(r) for r in x.edge_asymmetry(refs, back).collect()} == {("both", 1, 1), ("forward", 3, 2), ("backward", 1, 1)}


def test_examples_and_lists(spark):
    pairs = table(spark, [(f"h{i:02}", "a") for i in range(13)], "hpo_id string, sct_id string")
    got = x.examples(pairs, 10).collect()
    assert [r.hpo_id for r in got] == [f"h{i:02}" for i in range(10)] and {r.n_more for r in got} == {3}
    lookup = table(spark, [("h1", ["a", "b"]), ("h2", [])], "id string, values array<string>")
    assert [tuple(r) for r in x.explode_lookup(lookup, "m").collect()] == [("h1", "a", "m"), ("h1", "b", "m")]
    answers = table(spark, [(True, True, True), (True, False, True), (True, False, False), (False, False, False)], "unusable boolean, skipped boolean, truncated boolean")
    assert {tuple(r) for r in x.unusable_reasons(answers).collect()} == {("SKIPPED", 1), ("TRUNCATED", 1), ("INVALID", 1)}


def test_labels_fall_back_to_ids(spark):
    src = table(spark, [("h1", 1, "second"), ("h1", 0, "first"), ("h2", 0, None)], "concept_id string, ord int, value string")
    tgt = table(spark, [("a", 0, "toe")], "concept_id string, ord int, value string")
    pairs = table(spark, [("h1", "a"), ("h2", "b")], "hpo_id string, sct_id string")
    assert sorted(tuple(r) for r in x.labelled(pairs, src, tgt).select("hpo_label", "sct_label").collect()) == [("first; second", "toe"), ("h2", "b")]


def test_top_rejects(spark):
    rows = [("h1", "a", "CHECKED", "REJECT", 0.4), ("h2", "a", "CHECKED", "REJECT", 0.8), ("h0", "a", "CHECKED", "REJECT", 0.8), ("h3", "a", "CHECKED", "ACCEPT", 1.0), ("h4", "a", "SCT_NOT_FOUND", None, None)]
    got = x.top_rejects(table(spark, rows, "hpo_id string, sct_id string, status string, llm_decision string, confidence double"), 2)
    assert [r.hpo_id for r in got.collect()] == ["h0", "h2"]
