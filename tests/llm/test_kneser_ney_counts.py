"""The distributed Kneser-Ney model has the counts of all trusted rows."""

import random
import zlib

import numpy as np
import pytest

from lodestitch.llm import ngram_models


@pytest.mark.parametrize(("order", "n_top", "hot_share"), [(3, 1 << 18, 1.0), (3, 40, 1 / 30), (2, 40, 1 / 30)])
def test_perplexities_are_those_of_all_trusted_rows(spark, order, n_top, hot_share):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(200)], k=rng.randint(0, 40))) for _ in range(4600)] + [None, "never seen w0 w1"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = [i for i in range(4600) if i % 20]
    got = {r.doc_id: r for r in ngram_models.kneser_ney(df, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), order=order, n_top=n_top, hot_share=hot_share, chunk=20_000).collect()}
    said = [(t or "").encode() for t in texts]
    learned = [said[i] for i in trusted if zlib.crc32(str(i).encode()) % 4 != 3]
    model = ngram_models.KneserNey(*ngram_models.tokens(learned), order)
    assert len(got) == len(texts)
    for i in [*range(0, 4600, 37), 4600, 4601]:
        t, n = ngram_models.tokens([said[i]])
        assert got[i].n_tokens == len(t) and got[i].perplexity == pytest.approx(np.exp(-model.score(t, n).sum() / len(t)), rel=1e-5)
