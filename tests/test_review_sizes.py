"""Prompts and decisions of a review move pairs and answers, not what is said about targets."""

import json
import random

from test_sizes import shuffled

from lodestitch.operators import review


def test_texts_of_targets_are_not_dealt(spark):
    rnd = random.Random(3)
    said = {f"t{i}": "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=600)) for i in range(60)}
    target = review.describe(spark.createDataFrame([(k, "label", v) for k, v in said.items()], "concept_id string, attribute string, value string"), spark.createDataFrame([], "parent string, child string"))
    source = target.limit(0)
    reach = spark.createDataFrame([("t1", "t2", 1), ("t2", "t3", 1), ("t1", "t3", 2), ("t4", "t5", 1), ("t5", "t4", 1), ("t4", "t4", 2), ("t1", "gone", 1)], "ancestor string, descendant string, min_steps long")
    pairs = [(f"h{i}", f"t{k}") for i in range(300) for k in rnd.sample(range(60), 20)] + [("x", t) for t in ("t1", "t2", "t3", "t4", "t5", "gone", "t9")]
    chosen = review.select_pairs(spark.createDataFrame([(h, t, 9) for h, t in pairs], "hpo_id string, sct_id string, validity int"))
    with shuffled(spark, 600_000):
        got = {r.hpo_id: r.prompt for r in review.prompts(chosen, source, target, reach).collect()}
    assert len(got) == 301 and sum(p.count("* ID: ") for p in got.values()) == len(pairs)
    related = dict(zip(*(sorted_lines(got["x"], name) for name in ("ID", "Related candidates")), strict=True))
    name = {k: f'{k} ("{said[k]}")' if k in said else f'{k} ("None")' for k in (*said, "gone")}
    assert related == {
        "t1": f"broader than {name['gone']}; broader than {name['t2']}; broader than {name['t3']}", "t2": f"narrower than {name['t1']}; broader than {name['t3']}",
        "t3": f"narrower than {name['t1']}; narrower than {name['t2']}", "t4": f"broader than {name['t5']}; narrower than {name['t5']}", "t5": f"broader than {name['t4']}; narrower than {name['t4']}",
        "gone": f"narrower than {name['t1']}", "t9": "None"}


def sorted_lines(prompt, name):
    return [x.removeprefix(f"* {name}: ") for x in prompt.split("\n") if x.startswith(f"* {name}: ")]


def test_answers_are_dealt_as_they_were_given(spark):
    pairs = [(f"h{i}", f"t{k}") for i in range(500) for k in range(20)] + [("none", "t1"), (None, "t1"), ("h1", None), ("h1", "t3")]
    one = lambda k: {"sct_id": f"t{k}", "decision": "ACCEPT" if k % 2 else "REJECT", "confidence": 3, "rationale": "the same long rationale again " * 4}
    answers = [(f"h{i}", json.dumps({"mappings": [one(k) for k in (*range(1, 20), 30, 2)]})) for i in range(500)] + [(None, json.dumps({"mappings": [one(1)]})), ("none", None)]
    selected = spark.createDataFrame(pairs, "hpo_id string, sct_id string")
    with shuffled(spark, 700_000):
        got = review.parse_group(selected, spark.createDataFrame(answers, "hpo_id string, answer string")).collect()
    accepted = [(r.hpo_id, r.sct_id) for r in got if r.llm_decision == "ACCEPT"]
    assert len(got) == len(pairs) and len(accepted) == 5001 and accepted.count(("h1", "t3")) == 2
    assert {(r.hpo_id, r.sct_id) for r in got if r.unusable} == {(f"h{i}", "t0") for i in range(500)} | {("none", "t1"), (None, "t1"), ("h1", None)}
