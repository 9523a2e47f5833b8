"""What follows from counts is the same however many words and pairs are at hand in all tasks."""

import random

import pytest

from lodestitch.llm import ngram_models


@pytest.mark.parametrize("hot_share", [1.0, 1 / 40])
def test_scores_dont_depend_on_what_is_at_hand(spark, hot_share):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randint(1, 90))) for _ in range(200)] + ["", None, "never seen"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole, few = ({r.doc_id: tuple(r) for r in ngram_models.suffix_tree(df, n_top=n, hot_share=hot_share, min_divergence=1.0, chunk=5_000).collect()} for n in (1 << 18, 60))
    assert whole.keys() == few.keys()
    for k, row in whole.items():
        assert few[k][:5] == row[:5] and few[k][5:] == pytest.approx(row[5:], rel=1e-9)
