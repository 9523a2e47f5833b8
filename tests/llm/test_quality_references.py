"""Quality rules against a plain count of every column and distance, and on a corpus that is mostly junk."""

import math
import re
from collections import Counter

import pytest

from lodestitch.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, n_words string, kept string, ref_p string"
PLAIN = "The council met on the third day of the month and it was agreed that the bridge would be closed for repairs, as the water had risen over the road in the night. People from the village have to use the old path by the mill until the work is done, and they are not happy with this at all."


def junk(i):
    return " ".join(f"{w}{(i * 7 + k * 13) % 97}$#" for k, w in enumerate(["XKCD", "QQQ", "ZZT", "WWW"] * 20))


def plain_measure(text, lang):
    """Counts and shares of one text, character by character."""
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines, dup = set(), 0
    for line in t.split("\n"):
        dup += line in lines and bool(re.split(r"[\x20\x09-\x0D]+", line.strip(" \t\n\r\x0b\x0c"))[0])
        lines.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    kinds = Counter()
    for c in t:
        kinds[0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\x0b\x0c\r" else 4 if c in ".,;:!?'\"()-" else 5 if c in "#*$%&|<>@+=/\\^_`{}[]~" else 6] += 1
    common = quality_rules.bins()
    own = common.get(lang or "", common[""])
    bins = Counter(own.get(re.sub("[A-Z]", lambda m: m[0].lower(), w).encode(), -1) for w in words)
    n_bins = max(len(x) for x in common.values())
    p = [kinds[i] / max(1, len(t)) for i in range(7)]
    q = [bins[i] / max(1, len(words)) for i in range(n_bins)] + [bins[-1] / max(1, len(words))]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), p, q


def distance(p, q):
    total = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True))
    return math.sqrt(max(0.0, total / 2))


def test_every_column_against_plain_counts(spark):
    texts = [PLAIN, None, "", junk(1), PLAIN + "\n" + PLAIN, "a b c\na b c\n \n \n#|", "Der Rat hat am dritten Tag des Monats beschlossen, dass die Brücke für die Arbeit nicht mehr auf ist. " * 4, "x " * 30_000, "été à la plage " * 20]
    rows = [(i, t, lang, "", "", "") for i, t in enumerate(texts) for lang in ("en", "de", None, "xx")] + [(None, PLAIN, "en", "", "", ""), (0, PLAIN, "en", "", "", "")]
    got = quality_rules.score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    found = {(r.doc_id, r.lang): r for r in got}
    for i, t, lang, *_ in rows:
        r, (n, chars, symbols, dup, repeat, p, q) = found[i, lang], plain_measure(t, lang)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        ref, apart = quality_rules.shipped(lang), False
        if ref is None:
            assert r.char_distance is None and r.word_distance is None
        else:
            assert r.char_distance == pytest.approx(distance(p, ref[0]), abs=1e-9) and r.word_distance == pytest.approx(distance(q, ref[1]), abs=1e-9)
            apart = n >= 50 and chars >= 200 and (r.char_distance > 0.30 or r.word_distance > 0.45)
        base = n < 50 or 100 * repeat > 50 * n
        assert (r.base_failed, r.kept) == (base, not base and not apart)


def test_a_bad_corpus_doesnt_make_its_own_reference(spark):
    rows = [(i, junk(i), "en", "", "", "") for i in range(80)] + [(100 + i, f"{i} {PLAIN}", "en", "", "", "") for i in range(20)]
    kept = {r.doc_id for r in quality_rules.score(spark.createDataFrame(rows, SCHEMA)).collect() if r.kept}
    assert kept == set(range(100, 120))


def test_trusted_rows_can_be_the_reference(spark):
    """Rows named as trusted make the references, whatever else is in the table; languages without any keep the shipped ones."""
    rows = [(i, junk(i), "en", "", "", "") for i in range(80)] + [(100 + i, f"{i} {PLAIN}", "en", "", "", "") for i in range(20)] + [(200, PLAIN, "xx", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "doc_id long")
    kept = {r.doc_id for r in quality_rules.score(docs, trusted=trusted).collect() if r.kept}
    assert kept == set(range(80)) | {200}
    assert quality_rules.score(docs.limit(0), trusted=trusted).count() == 0


def test_string_keys_stay(spark):
    r = quality_rules.score(spark.createDataFrame([("a1", PLAIN, "en"), ("b", None, None)], "doc_id string, text string, lang string")).collect()
    assert {(x.doc_id, x.kept) for x in r} == {("a1", True), ("b", False)}
