"""Stems and tokens with fixed results, and the size bands of the Jaccard join against all pairs."""

import random

import pytest

from lodestitch.functions.tokens import PROTECTED, STOP_WORDS, TokenNormalizer, stem
from lodestitch.operators import candidates

STEMS = {
    "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "radically": "radic", "differently": "differ", "analogously": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formality": "formal", "sensitivity": "sensit",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "communism": "commun", "activate": "activ", "angularity": "angular", "homologous": "homolog", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controlling": "control", "roll": "roll",
    "abnormality": "abnorm", "abnormalities": "abnorm", "seizures": "seizur", "seizure": "seizur", "is": "is", "été": "été", "b12": "b12", "": "",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_protected_words_are_kept():
    assert "without" in STOP_WORDS & PROTECTED and "the" in STOP_WORDS - PROTECTED


@pytest.mark.parametrize(
    ("options", "tokens"),
    [
        ({}, [["abnorm", "no", "seizur", "abnorm"], [], [], [], ["first", "rib", "without", "b-cell", "être"], ["sore", "toe"]]),
        ({"stem": False}, [["abnormalities", "no", "seizures", "abnormality"], [], [], [], ["first", "ribs", "without", "b-cell", "être"], ["sore", "toes"]]),
        ({"stem": False, "remove": False, "lower": False}, [["Abnormalities", "of", "no", "seizures", "Abnormality"], [], [], ["of", "the"], ["First", "ribs", "without", "B-cell", "être"], ["sore", "toes"]]),
        ({"protected": frozenset()}, [["abnorm", "seizur", "abnorm"], [], [], [], ["rib", "b-cell", "être"], ["sore", "toe"]]),
    ],
)
def test_normalize(spark, options, tokens):
    texts = ["Abnormalities of (no) seizures, Abnormality", None, " \t", "of the", "First ribs/without B-cell: être", "sore  toes"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts * 2)], "id long, term string, tokens string")
    if options.get("remove", True):
        tokens = [*tokens[:3], [], *tokens[4:]]
    got = TokenNormalizer(**options).normalize(df).orderBy("id").collect()
    assert [r.tokens for r in got] == tokens * 2


def test_lemmas(spark):
    lemmas = spark.createDataFrame([("feet", "foot"), ("feet", "zz"), ("was", "be"), ("larger", "large")], "token string, lemma string")
    df = spark.createDataFrame([("Feet was larger",), ("feet",)], "term string")
    assert [r.tokens for r in TokenNormalizer(lemmas=lemmas).normalize(df).orderBy("term").collect()] == [["foot", "larg"], ["foot"]]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9])
def test_jaccard_equals_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 10))
    words = [f"w{i}" for i in range(14)]
    make = lambda n, k: [(f"{k}{i}", " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5, 11, 20])))) for i in range(n)]
    s, t = make(60, "s"), make(60, "t")
    want = {(a, b): len({*x.split()} & {*y.split()}) / len({*x.split()} | {*y.split()}) for a, x in s for b, y in t}
    got = {(r.hpo_id, r.sct_id): r.confidence for r in candidates.jaccard(*(spark.createDataFrame(x, "concept_id string, term string") for x in (s, t)), threshold).collect()}
    assert got == {k: v for k, v in want.items() if v > threshold}
