"""Positions pass in waves of buckets: each once, whatever the number of waves."""

import random

import numpy as np
import pytest

from lodestitch.llm import ngram_models
from lodestitch.llm.jaccard import word_hashes


def _rows(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(150)], k=rng.randint(0, 60))) for _ in range(400)] + ["", None]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, "w1 w2", None)], "doc_id long, text string, lang string")


def test_waves_move_each_position_once(spark):
    df = _rows(spark).selectExpr("doc_id", "CAST(coalesce(text, '') AS binary) AS text", "doc_id % 3 = 0 AS learn", "lang AS extra").na.fill(False, ["learn"])
    none = np.zeros(0, np.uint64)
    deal = ngram_models.Deal(df, 2, 3_000, none, none, none)
    counts = spark.createDataFrame([], "a long, w long, c long")
    want = sum(len(ngram_models.tokens([bytes(r.text)])[0]) for r in df.collect())
    for waves in (1, 2, 4):
        moved = [x.filter("blob IS NOT NULL AND chunk >= 0").selectExpr("sum(n)", "count(DISTINCT bucket)").first() for x in deal.buckets_of(df, counts, waves)]
        assert len(moved) == waves and sum(x[0] or 0 for x in moved) == want
        assert max(x[1] for x in moved) <= deal.buckets // waves


def test_perplexities_dont_depend_on_waves(spark):
    df = _rows(spark)
    trusted = df.filter("doc_id % 5 > 0").select("doc_id").distinct()
    got = [sorted((tuple(r) for r in ngram_models.kneser_ney(df, trusted, waves=n, n_top=30, hot_share=1 / 30, chunk=4_000).collect()), key=lambda r: (r[0] is None, r[0] or 0)) for n in (1, 4)]
    assert len(got[0]) == len(got[1]) == 405
    for x, y in zip(*got, strict=True):
        assert x[:3] == y[:3] and x[5] == y[5] and x[3:5] == pytest.approx(y[3:5], rel=1e-9)


def test_tree_scores_dont_depend_on_waves(spark):
    df = _rows(spark)
    got = [sorted((tuple(r) for r in ngram_models.suffix_tree(df, waves=n, n_top=30, hot_share=1 / 30, min_divergence=1.0, chunk=4_000).collect()), key=lambda r: (r[0] is None, r[0] or 0)) for n in (1, 2)]
    assert len(got[0]) == len(got[1]) == 405
    for x, y in zip(*got, strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9)


def test_word_hashes_dont_depend_on_neighbours_or_length():
    long = b"x" * 63, b"x" * 64, b"x" * 65, b"Y" * 300, b"y" * 300
    words, n = word_hashes([b" ".join(long), b"", b" \t", *long])
    assert n.tolist() == [5, 0, 0, 1, 1, 1, 1, 1] and (words[:5] == words[5:]).all() and words[3] == words[4] and len(set(words.tolist())) == 4
