import math
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from lodestitch.llm import decontaminate, jaccard, licenses, ngram_models, packing, pii, quality_rules, sharding, toxicity
from lodestitch.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, cid string, words string"
LONG = " ".join(f"word{i * i % 977}" for i in range(20_000))
TEXTS = ["", None, "one", "a b c d e f g h", "A b C d e f g h", "a b c d e f g h i", "x\ty\nz  q é", LONG, LONG + " more", "a b c d e f g h"]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 2 else "s", 0, "h", "c", "w") for i, t in enumerate(texts)], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def shingles(t, k=4):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(texts):
    s = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(s):
            for j, b in enumerate(s):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return {i: (len(s[i]), label[i]) for i in range(len(texts))}


def test_jaccard_equals_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    near = [" ".join(base[:i] + ["new"] + base[i + 1 :]) for i in range(0, 60, 7)] + [" ".join(base[i:]) for i in range(12)]
    texts = TEXTS + near + [" ".join(base[:25] + [f"v{j}{i}" for i in range(n)]) for j, n in enumerate((1, 2, 3, 40))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(table(spark, texts)).collect()}
    assert got == classes(texts)


def test_pipeline_drops_near_copies_of_five_words(spark):
    base = [f"w{i}" for i in range(50)]
    docs = table(spark, [" ".join(base), " ".join(base[:25] + ["new"] + base[26:])])
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [0]


def test_parities_lose_no_pair(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows, pairs, sets = [], [], {}
    for n in (1, 2, 9, 63, 64, 65, 100, 127, 130, 300, 1030):
        whole = rng.integers(1 << 62, size=2 * n, dtype=np.uint64)
        for changed in range(0, n + 1, max(1, n // 12)):
            for extra in (0, max(0, n // 12)):
                a, b = len(sets), len(sets) + 1
                sets[a], sets[b] = np.unique(whole[:n]), np.unique(whole[changed : n + extra + changed])
                pairs.append((a, b))
    for c, s in sets.items():
        rows += [(c, -1, len(s), jaccard.parities(s).tolist()), (c, 0, len(s), s.view(np.int64).tolist())]
    cut = spark.createDataFrame(rows, "cid long, fragment int, n long, grams array<long>")
    asked = spark.createDataFrame(pairs, "a long, b long")
    share = {(a, b): (len(np.intersect1d(sets[a], sets[b])), len(np.union1d(sets[a], sets[b]))) for a, b in pairs}
    near = {x for x, (c, u) in share.items() if 100 * c >= 85 * u}
    left = {tuple(r) for r in jaccard.close(cut, asked, 85, 100).collect()}
    assert near <= left and len(left) < len(pairs) / 2
    assert {tuple(r) for r in jaccard.overlaps(cut, asked, 85, 100).collect()} == near


def test_prefixes_are_counted_exactly(spark):
    from collections import Counter

    import numpy as np

    rng = np.random.default_rng(5)
    common, pool = rng.integers(1 << 62, size=6, dtype=np.uint64) * np.uint64(4), rng.integers(1 << 62, size=400, dtype=np.uint64) * np.uint64(4)
    sets, rows = {}, []
    for c in range(120):
        own = rng.integers(1 << 62, size=rng.integers(0, 9), dtype=np.uint64)
        sets[c] = np.unique(np.concatenate((common if c % 3 else common[:2], rng.choice(pool, rng.integers(1, 80)), own)))
        half = len(sets[c]) // 2
        rows += [(c, f, len(sets[c]), part.view(np.int64).tolist()) for f, part in enumerate((sets[c][:half], sets[c][half:])) if len(part)]
    df = Counter(g for s in sets.values() for g in s.tolist())
    want = {}
    for c, s in sets.items():
        n, shared = len(s), sorted((g for g in s.tolist() if df[g] > 1), key=lambda g: (df[g], g))
        length = n - -(-85 * n // 100) + 1 - (n - len(shared))
        if length > 0:
            want[c] = (n, n - len(shared), shared[:length])
    cut = spark.createDataFrame(rows, "cid long, fragment int, n long, grams array<long>").repartition(3)
    for hot, size in ((64, 2_000_000), (2, 500), (1, 50)):
        got = {r.cid: (r.n, r.own, [g % (1 << 64) for g in r.grams]) for r in jaccard.rarest(cut, 85, 100, hot, size).collect()}
        assert got == want


def test_packed_keys_come_back():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, classes in ((1, 1), (5, 2), (70_000, 70_000)):
        k, c = np.sort(rng.integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2)), rng.integers(-classes, classes, size=n)
        got = jaccard._unpacked(*jaccard._packed(k, c))
        assert (got[0] == k).all() and (got[1] == c).all()


def test_jaccard_of_string_and_null_keys(spark):
    texts = [("b", "a b c d e f g h"), ("a", "a b c d e f g h"), (None, "a b c d e f g h"), ("c", None), (None, "x y z q r s")]
    got = jaccard.join(spark.createDataFrame(texts, "doc_id string, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([("b", 5, "a"), ("a", 5, "a"), ("None", 5, "None"), ("c", 0, "c"), ("None", 3, "None")])


def test_segments_of_close_sets_meet():
    import numpy as np

    rng, uppers = np.random.default_rng(1), jaccard.bands(85, 100)
    for n in [*range(1, 60), 300, 2000]:
        for _ in range(5):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            cut = rng.integers(0, n * 15 // 100 + 1)
            b = np.unique(np.append(a[rng.permutation(n)[cut:]], rng.integers(0, 1 << 63, rng.integers(0, n * 9 // 100 + 1), dtype=np.uint64)))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
                assert set(jaccard.segment_keys(a, 85, 100, uppers).tolist()) & set(jaccard.segment_keys(b, 85, 100, uppers).tolist())


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    pieces, where = {}, {}
    for r in packing.pack(table(spark), tokenizer_path(), with_ids=True).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, list(r.ids)))
        where.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(TEXTS):
        assert [x for _, p in sorted(pieces[i]) for x in p] == [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    for s in where.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0


def test_sharding(spark):
    rows = sharding.interleave(table(spark, TEXTS * 9), n_shards=4).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 90 and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(4):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))


def test_suffix_tree_base(spark):
    texts = TEXTS * 3
    rows = ngram_models.suffix_tree(table(spark, texts), min_count=2, min_divergence=0.1).collect()
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for i, t in enumerate(texts) if not held[i] for w in [*words(t), ""])
    n, v = sum(c.values()), len(c)
    for r in rows:
        mine = [*words(texts[r.doc_id]), ""]
        assert (r.n_tokens, r.train_tokens, r.held_out, r.n_known) == (len(mine), n, held[r.doc_id], sum(c[w] > 0 for w in mine))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in mine))
        assert r.score <= 0


def test_suffix_tree_uses_rare_contexts(spark):
    texts = [f"alpha{i % 20} beta{i % 20} gamma{i % 20} delta{i % 20}" for i in range(100)]
    held = [r for r in ngram_models.suffix_tree(table(spark, texts)).collect() if r.held_out]
    assert held and all(r.score > 0.6 * r.base_score for r in held)


def test_kneser_ney_prefers_known_text(spark):
    texts = ["the cat sat on the mat and the dog sat too"] * 30 + ["zq vx kj wp", None]
    got = {r.doc_id: r for r in ngram_models.kneser_ney(table(spark, texts), spark.range(30).toDF("doc_id")).collect()}
    assert len(got) == 32 and got[0].kept and got[30].perplexity > 5 * got[0].perplexity and not got[30].kept


def test_kneser_ney_sums_to_one():
    import random

    import numpy as np

    rng = random.Random(6)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.4)), 12)}" for _ in range(rng.randrange(1, 30))).encode() for _ in range(60)]
    model = ngram_models.KneserNey(*ngram_models.tokens(texts), 3)
    vocabulary = sorted({w for t in texts for w in t.split()}) + [b"unseen"]
    for lead in (b"", b"w0", b"w0 w1", b"w3 w2 w1", b"unseen w0", b"unseen"):
        n = len(lead.split())
        said = [np.exp(model.score(*ngram_models.tokens([lead + b" " + w]))[n]) for w in vocabulary]
        assert sum(said) + np.exp(model.score(*ngram_models.tokens([lead]))[n]) == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("hot_share", [1.0, 0.06])
def test_suffix_tree_equals_plain_model(spark, hot_share):
    import random

    rng = random.Random(8)
    texts = [" ".join(rng.choice(("a b c d", "a b e f", "g a", "h", "b c x", "q r s t u")) for _ in range(rng.randrange(6))) for _ in range(150)] + [None, "never seen words"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    seqs = [[*words(t), ""] for t in texts]

    def context(s, i, d):
        return tuple(s[j] if j >= 0 else None for j in range(i - d, i))

    counts = {}
    for s, out in zip(seqs, held, strict=True):
        for i, w in enumerate(s):
            for d in range(4):
                if not out:
                    counts.setdefault(context(s, i, d), Counter())[w] += 1
    n, v = sum(counts[()].values()), len(counts[()])
    hot = {w for w in counts[()] if w and counts[()][w] > hot_share * n} | ({None} if counts[()][""] > hot_share * n else set())
    assert (len(hot) > 2) == (hot_share < 1)

    def p(w, ctx):
        if not ctx:
            return (counts[()][w] + 1) / (n + v + 1)
        c = counts.get(ctx, Counter())
        if ctx[0] in hot and len(ctx) == 1:
            often = {x: k / sum(c.values()) for x, k in c.items() if k >= 2}
            return often.get(w, 0) + (1 - sum(often.values())) * p(w, ())
        size, low = sum(c.values()), p(w, ctx[1:])
        if size < 2 or sum(k * math.log(k / size / p(x, ctx[1:])) for x, k in c.items()) < 1.5:
            return low
        return (c[w] + len(c) * low) / (size + len(c))

    for r in ngram_models.suffix_tree(table(spark, texts), min_divergence=1.5, chunk=300, hot_share=hot_share).collect():
        s = seqs[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(p(w, context(s, i, 3))) for i, w in enumerate(s)))
    every = set(counts[()]) | {"unseen"}
    for ctx in list(counts)[:40]:
        assert sum(p(w, ctx) for w in every) == pytest.approx(1)


def test_pii(spark):
    t = "mail a.b@c.de, card 4539 1488 0343 6467 and +49 (30) 1234-5678, 10.0.0.255 but 10.0.0.256"
    r = pii.find(table(spark, [t, None, t]), keep_text=True).orderBy("doc_id").collect()
    assert (r[0].n_email, r[0].n_ip, r[0].n_card, r[0].n_phone) == (1, 1, 1, 1) and r[0].spans == r[2].spans and r[1].spans == ""
    assert r[0].redacted.startswith("mail <EMAIL>, card <CARD> and <PHONE>, <IP> but")
    assert pii.redact(table(spark, [t, None])).count() == 2


def test_pii_finds_a_number_in_another_notation(spark):
    texts = ["call +442079460958 now", "call +442079460958 or 442079460958 or 44 20 7946 0958 or 020-7946-0958 or 442079460959"] + [f"item 4420{i:08d} x" for i in range(100)]
    r = pii.find(table(spark, texts), keep_text=True).orderBy("doc_id").collect()
    assert r[1].redacted == "call <PHONE> or <PHONE> or <PHONE> or <PHONE> or 442079460959" and r[1].n_phone == 1
    assert all(x.spans == "" for x in r[2:])


def test_pii_finds_named_secrets_and_their_repeats(spark):
    names = [f"{i * 7919 % 99991:05d}{'ab3f9c'[i % 6]}" * 6 for i in range(40)]
    texts = [f'the token = "{x[:32]}" and then {x[:32]} again' for x in names] + [f"order {i} of 12 and {i * 1000003} pieces" for i in range(100, 160)]
    r = pii.find(table(spark, texts), keep_text=True).orderBy("doc_id").collect()
    assert all(x.redacted == 'the token = "<SECRET>" and then <SECRET> again' for x in r[:40])
    assert all(x.spans == "" for x in r[40:])


def test_pii_messages_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    n = len(pii.LABELS)
    unary = rng.normal(size=(5, n))
    edges = [(0, 1), (1, 2), (1, 3), (3, 4)]
    w = rng.normal(size=(len(edges), n, n))
    w = w + w.transpose(0, 2, 1)
    want = np.zeros((5, n))
    for y in itertools.product(range(n), repeat=5):
        p = np.exp(sum(unary[i, k] for i, k in enumerate(y)) + sum(m[y[i], y[j]] for (i, j), m in zip(edges, w, strict=True)))
        for i, k in enumerate(y):
            want[i, k] += p
    assert pii.infer(unary, edges, w) == pytest.approx(want / want.sum(1, keepdims=True), abs=1e-4)


def test_pii_redact_keeps_clashing_columns_and_nulls(spark):
    docs = spark.createDataFrame([("k", "mail a.b@c.de", "x", 1), (None, None, None, None), ("k", "", "y", 2)], "redacted string, text string, _row_of_redact string, spans int")
    got = pii.redact(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [("k", "mail <EMAIL>", "x", 1), (None, None, None, None), ("k", "", "y", 2)]
    assert [r.doc_id for r in pii.find(docs, key="redacted").collect()] == ["k", None, "k"]


def test_toxicity(spark):
    texts = [f"the sun is over field {i} " + ("you idiot clown" if i % 4 == 0 else "and all is well") for i in range(200)] + ["", None]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(table(spark, texts), labels).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(200)) and got[200].predicted == got[201].predicted == 0
    assert {r.predicted for r in toxicity.score(table(spark), labels.limit(0)).collect()} == {0}


def test_toxicity_keeps_all_terms_under_copies(spark):
    copy = " ".join(f"odd{j}" for j in range(600))
    texts = [f"the sun is over field {i} " + ("you idiot clown" if i % 8 == 0 else "and all is well") for i in range(200)] + [copy] * 100
    labels = spark.createDataFrame([(i, int(i % 8 == 0 or i >= 200)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(table(spark, texts), labels).collect()}
    assert got == {i: int(i % 8 == 0 or i >= 200) for i in range(300)}


def test_block_max_is_exact():
    import numpy as np

    rng = np.random.default_rng(3)
    vs = [{int(t): float(w) for t, w in zip(rng.permutation(40)[:5], rng.random(5), strict=True)} for _ in range(300)]
    index = toxicity.BlockMax([(np.array(list(v)), np.array(list(v.values()))) for v in vs], 40, 16)
    for q in vs[:30]:
        every = sorted(((-sum(w * v.get(t, 0) for t, w in q.items()), i) for i, v in enumerate(vs)))[:10]
        assert [s for s, _ in index.nearest(q, 10)] == pytest.approx([-s for s, _ in every], abs=1e-5)


def test_licenses(spark):
    t = ["it is CC BY, all rights reserved", "Licensed under the Apache License, Version 2.0 now", None, "by cc"]
    r = licenses.scan(table(spark, t)).orderBy("doc_id").collect()
    assert [(x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in r] == [(7, 2, 2, 4, "cc-by,reserved"), (9, 0, None, None, ""), (0, 0, None, None, ""), (2, 0, None, None, "")]
    assert r[1].labels == "apache-2.0"


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    docs = table(spark, ["lead in " + item + " and out", item.upper(), "one two three four five only", None])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()) == [(0, 1), (1, 1)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [2, 3]


def test_decontamination_of_items_that_share_shingles(spark):
    head, own = [f"h{i}" for i in range(29)], [[f"t{j}x{i}" for i in range(29)] for j in range(5)]
    twice = [f"w{i}" for i in range(58)]
    items = [(j, " ".join(head + own[j])) for j in range(5)] + [(10 + j, " ".join(twice)) for j in range(3)]
    docs = [" ".join([*(head + own[0])[:45], "new", *(head + own[0])[46:]]), " ".join([*twice[:30], "new", *twice[31:]])]
    got = decontaminate.matches(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 0), (1, 10), (1, 11), (1, 12)]


def test_decontamination_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    head = [f"h{i}" for i in range(30)]
    items = {i: [*head, *(f"t{i}x{j}" for j in range(3))] for i in range(50)} | {50 + i: [f"w{rng.randrange(4000)}" for _ in range(rng.choice((12, 40, 41, 90)))] for i in range(60)}
    items |= {110: items[59][3:], 111: list(items[70])}
    docs = {}
    for i, w in items.items():
        docs[len(docs)] = [*(f"a{rng.randrange(900)}" for _ in range(rng.randrange(30))), *w, "end"]
        for n in (1, 2, 3):
            near = list(w)
            for _ in range(n):
                at = rng.randrange(len(near))
                near[at : at + 1] = rng.choice(([], ["new"], [near[at], f"n{at}"]))
            docs[len(docs)] = ["lead", *near, "and", *(f"b{rng.randrange(900)}" for _ in range(20))]

    def grams(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want, clear = set(), set()
    for d, w in docs.items():
        g = grams(w)
        for i, x in items.items():
            own, size = set(grams(x)), len(x) - 4
            if own & set(g):
                best = max((len(own & set(g[s : s + size])) / len(own | set(g[s : s + size])) for s in range(len(g))), default=0)
                want |= {(d, i)} if best >= 0.8 else set()
                clear |= {(d, i)} if best < 0.8 and i >= 50 else set()
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(table(spark, [" ".join(w) for w in docs.values()]), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()}
    assert all((4 * i, i) in found for i in items)
    assert len(found & want) >= 0.97 * len(want) and not found & clear


def test_quality_rules(spark):
    r = {x.doc_id: x for x in quality_rules.score(table(spark, ["a b c\na b c\n#|", None, LONG])).collect()}
    assert (r[0].n_words, r[0].word_chars, r[0].n_symbols, r[0].n_dup_lines, r[0].n_repeat_words, r[0].base_failed) == (7, 8, 2, 1, 6, True)
    assert r[1].base_failed and not r[1].kept


def test_empty_tables(spark):
    none, labels = table(spark, []), spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        packing.pack(none, tokenizer_path()), sharding.interleave(none), toxicity.score(none, labels), decontaminate.matches(none, items), decontaminate.matches(table(spark), items),
        ngram_models.kneser_ney(none, labels), ngram_models.suffix_tree(none), jaccard.join(none), pii.find(none), pii.redact(none), quality_rules.score(none), licenses.scan(none),
    ):
        assert out.count() == 0
