"""Packing honours the tokenizer it is given."""

import pytest

from lodestitch.llm import packing
from lodestitch.llm.queries import tokenizer_path

TEXTS = ["", None, "Two  Words", "UPPER lower\tTab\n\nnew   line ", "it's 12 o'clock, don't  wait", "été à Zürich 12", "  lead", "a" * 300, "x y z", "<|endoftext|> a", "日本 words"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers(spark, name):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    tok = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(TEXTS)], "doc_id string, text string")
    got = {}
    for r in packing.pack(docs, path, capacity=64, with_ids=True).collect():
        got.setdefault(r.doc_id, []).append((r.start, list(r.ids)))
    assert {k: [x for _, p in sorted(v) for x in p] for k, v in got.items()} == {f"k{i}": [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(TEXTS)}
    assert packing.Words(path).fast == (name == "word_bpe_49k.json")
