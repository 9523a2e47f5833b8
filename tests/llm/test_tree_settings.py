"""Scores of the suffix tree are those of the texts alone, whatever the cluster's settings."""

import random

import pytest

from lodestitch.llm import ngram_models


def test_scores_dont_depend_on_partitions_or_chunks(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(400)], k=rng.randint(1, 120))) for _ in range(300)] + ["w0 w1 w2 " * 400, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    was, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts, chunk, files in ((4, 8_000_000, 1), (64, 8_000_000, 5), (13, 2_000, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append({r.doc_id: tuple(r) for r in ngram_models.suffix_tree(df.repartition(files, "doc_id"), chunk=chunk, hot_share=1 / 50, min_divergence=1.0).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    for other in got[1:]:
        assert other.keys() == got[0].keys()
        for k, row in got[0].items():
            assert other[k][:5] == row[:5] and other[k][5:] == pytest.approx(row[5:], rel=1e-9)
