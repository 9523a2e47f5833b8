import hashlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestitch.llm import filter_audit, html_extraction, vector_codes

# ---- main text of pages

PARAGRAPHS = [f"Paragraph {i} tells at some length what happened on the {i}th day &amp; why it mattered to all who were there." for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = " ".join(p.replace("&amp;", "&") for p in PARAGRAPHS)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("no markup at all", "no markup at all"),
        (f"<nav><a href=/>Home</a></nav><h1>Title</h1>{BODY}<footer>&copy; site</footer>", f"Title {TEXT}"),
        (f"<div id=content>{BODY}</div><div id=comments><p>I do not agree with any of this, and here is a long reason why.</p></div>", TEXT),
        (f"<div class=wrap><div class=x1>Buy now</div><div class=x2><div class=x3>{BODY}</div></div><div class=x4><p>Made by us</p></div></div>", TEXT),
        (f"<div class='cookie-notice'>We use cookies for everything we can think of on this site.</div><main>{BODY}</main><aside>Also read this</aside>", TEXT),
        (f"<article><header><h1>T</h1><p>By Someone</p></header>{BODY}<form><label>Mail</label><input></form></article>", f"T {TEXT}"),
        (f"<article>{BODY}<div class=ad>Buy these shoes</div><p>The end.</p></article>", f"{TEXT} The end."),
        ("<p>a<b>b</b>c&nbsp;&eacute;&#x41;&lt;i&gt;<br>d\n\t e<script>var x = '<p>no</p>'</script></p><!-- <p>no</p> --><style>p {}</style>", "abc éA<i> d e"),
        ("<p title='a > b'>one<p>two<li>three<li>four</ul></div>", "one two three four"),
        (f"{BODY}<h2>Comments</h2><section class=comments><p>Nice</p></section>", TEXT),
        (f"<ul>{'<li><a href=/>A link of some length</a></li>' * 9}</ul><div>{BODY}</div>", TEXT),
        (f"<body class='has-sidebar no-comments'><div class=content-main>{BODY}</div></body>", TEXT),
        ("<div>first part of it</div><div>second part of it</div>", "first part of it second part of it"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
        ("<p>3 < 4 and 5 > 4", "3 < 4 and 5 > 4"),
        ("<script>unclosed", ""),
    ],
)
def test_main_text(page, text):
    assert html_extraction.main_text(page) == text


def test_extract_rows(spark):
    long = "<div>" * 2_000 + "".join(f"<p>Line {i} of a very long page</p>" for i in range(20_000))
    rows = [(1, "u", BODY, "t", 0), (1, "u", BODY, "t", 0), (None, None, None, None, 0), (3, "", long, "x", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = html_extraction.extract(pages)
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    got = Counter(map(tuple, out.collect()))
    want = " ".join(f"Line {i} of a very long page" for i in range(20_000))
    assert got == Counter([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (None, None, "", 0), (3, "", want, len(want))])
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_windows_against_a_plain_scan():
    """Blocks of lines, their fullest windows and the stretches between empty windows, line by line."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        found, path, n = [], (1,), 1
        for _ in range(int(rng.integers(1, 25))):
            if rng.random() < 0.3:
                n += 1
                path = (*path[: int(rng.integers(1, len(path) + 1))], *((n,) if rng.random() < 0.7 else ()))
            w = int(rng.choice([0, 5, 40, 120, 400]))
            found.append(html_extraction.Line("x" * max(w, 1), w, path, bool(rng.random() < 0.1), bool(rng.random() < 0.2)))
        spread, blocks = [], []
        for i, x in enumerate(found):
            gap = 0
            if i and not found[i - 1].heading:
                a, b = set(found[i - 1].within), set(x.within)
                gap = len(a ^ b)
            spread += [None] * gap + [i]
            if not blocks or gap:
                blocks.append([])
            blocks[-1].append(i)
        of = {i: k for k, b in enumerate(blocks) for i in b}
        peak = [max(sum(found[i].weight for i in b[max(0, e - 2) : e + 1]) for e in range(len(b))) for b in blocks]
        at = {i: k for k, i in enumerate(spread) if i is not None}
        weigh = lambda k: found[spread[k]].weight if 0 <= k < len(spread) and spread[k] is not None else 0
        stretch, s = {}, 0
        for k in range(len(spread)):
            s += weigh(k) + weigh(k - 1) + weigh(k - 2) == 0
            stretch[k] = s
        limit = max(1, min(300, 0.2 * max(peak)))
        runs = []
        for s in sorted(set(stretch.values())):
            inside = [i for i in at if stretch[at[i]] == s]
            hot = [of[i] for i in inside if found[i].weight and peak[of[i]] >= limit]
            if hot:
                lines = [i for i in inside if min(hot) <= of[i] <= max(hot) and (found[i].weight or found[i].heading)]
                runs.append(range(min(lines), max(lines) + 1))
        if any(found[i].article for r in runs for i in r):
            runs = [r for r in runs if any(found[i].article for i in r)]
        totals = [sum(found[i].weight for i in r) for r in runs]
        want = [i for r, t in zip(runs, totals, strict=True) if t >= max(totals) / 3 for i in r]
        while want and found[want[-1]].heading and not all(found[i].heading for i in want):
            want.pop()
        assert html_extraction.main_lines(found) == want


# ---- filters

DOCS = "doc_id long, text string, source string, n long, good string, part string"


def replay(docs, labels):
    """The audit by running all orders over all documents."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    fails = []
    for i, t, *_ in docs:
        t = t or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        e = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs)
        fails.append((len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), e))
    out = set()
    for part in {d[2] or "" for d in docs}:
        mine = [(d[0], f) for d, f in zip(docs, fails, strict=True) if (d[2] or "") == part]
        rows, shapley = [], Counter()
        for order in permutations(range(5)):
            left = mine
            for step, k in enumerate(order, 1):
                gone, stay = [x for x in left if x[1][k]], [x for x in left if not x[1][k]]
                failing = [x for x in mine if x[1][k]]
                shapley[k] += len(gone)
                rows.append((k, ["".join("ABCDE"[x] for x in order), step, len(stay), len(gone), len(failing) - len(gone), sum(sum(f) == 1 for _, f in failing), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]))
                left = stay
        out |= {(part, *r, shapley[k]) for k, r in rows}
    return out


def test_audit_replays_all_orders(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["Alpha", "beta", "GAMMA", "d#", "e", "é", "zeta|", "eta", " x"]
    docs = [(None, None, None, 0, "g", "p"), (None, "same", "s", 0, "g", "p"), (7, "same", "s", 0, "g", "p"), (7, "same", "t", 0, "g", "p"), (7, "same", "t", 0, "g", "p"), (8, "same", "t", 0, "g", "p"), (9, "", "s", 0, "", ""), (10, None, "s", 0, "", "")]
    docs += [(i, " \t\n"[i % 3].join(rng.choice([*vocabulary, *map(str, range(60))], int(rng.integers(1, 90)))), ["s", "t", None][i % 3], 0, "", "") for i in range(11, 60)]
    docs += [(i + 100, t, "s", 0, "", "") for i, t, *_ in docs[20:30]] + [(5, "long " * 40_000, "u", 0, "", "")]
    labels = [(i, i % 2, i % 5 == 0) for i in range(9, 60)] + [(9, 0, 1), (None, 1, 1), (12, None, None)]
    out = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(a, b, None if c is None else int(c), "x") for a, b, c in labels], "doc_id long, quality int, toxic int, source string"))
    got = list(map(tuple, out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()))
    assert len(got) == len(set(got)) == 4 * 600
    assert set(got) == replay(docs, labels)


def test_audit_of_nothing_and_string_keys(spark):
    labels = spark.createDataFrame([("a", 1, 0)], "doc_id string, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id string, text string, source string")
    assert filter_audit.audit(none, labels).count() == 0
    two = spark.createDataFrame([("a", "x", "s"), ("b", "x", "s")], none.schema)
    row = filter_audit.audit(two, labels).filter("filter_order = 'EABCD' AND step = 1").first()
    assert (row.kept, row.removed, row.good_lost, row.shapley) == (1, 1, 0, 60)


# ---- vector codes


def plain_codes(rows):
    """(vec_id, code, error, label) and the codebooks' digest, by all distances."""
    kept = [(i, np.floor(1024 * np.asarray(v, float)).astype(np.int64), x) for i, x, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v, _ in kept])
    order = sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], tuple(kept[k][1])))[:256]
    parts = np.split(x, 4, axis=1)
    books = [p[order].copy() for p in parts]

    def assign(p, c):
        d = ((p[:, None] - c[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(4):
        for p, c in zip(parts, books, strict=True):
            i, _ = assign(p, c)
            for k in set(i.tolist()):
                c[k] = p[i == k].sum(axis=0) // (i == k).sum()
    found = [assign(p, c) for p, c in zip(parts, books, strict=True)]
    sha = hashlib.sha256(",".join(str(int(v)) for c in books for e in c for v in e).encode()).hexdigest()
    return [(i, "".join(f"{f[0][n]:02x}" for f in found), int(sum(f[1][n] for f in found)), x) for n, (i, _, x) in enumerate(kept)], sha


@pytest.mark.parametrize("n", [1, 3, 700])
def test_codes_against_all_distances(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [None, 1, 2, 2][i % 4], rng.choice([-0.5, -0.001, 0.25, 0.75, 3.0], 8).tolist() if i % 3 else rng.normal(size=8).tolist()) for i in rng.permutation(n)]
    rows += [(n + 1, 1, None), (n + 2, 1, [0.0] * 7 + [None]), (n + 3, 1, [0.0] * 7 + [float("nan")]), (n + 4, None, [float("inf")] + [0.0] * 7), (n + 5, 2, [0.5] * 8), (n + 5, 2, [0.5] * 8), (None, 2, [0.25] * 8)]
    df = spark.createDataFrame([(*r, "c", "e") for r in rows], "vec_id long, label int, embedding array<double>, code string, error string").repartition(3)
    out = vector_codes.compress(df).collect()
    want, sha = plain_codes(rows)
    by_label = Counter()
    for _, _, e, label in want:
        by_label[label] += e
    assert Counter(map(tuple, out)) == Counter((i, c, e, by_label[x], sha) for i, c, e, x in want)


def test_codes_of_odd_widths(spark):
    schema = "vec_id long, label string, embedding array<float>"
    none = vector_codes.compress(spark.createDataFrame([(1, "a", None), (2, "a", [float("nan")])], schema))
    assert none.count() == 0 and vector_codes.compress(none.sparkSession.createDataFrame([], schema)).count() == 0
    rows = [(1, "a", [1.0, 2.0, 3.0]), (2, "a", [1.0, 2.0, 3.5]), (3, None, [1.0]), (4, None, [])]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.compress(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("00000000", 0, 0), 2: ("00000100", 0, 0), 3: (None, None, None), 4: (None, None, None)}
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(spark.createDataFrame([(1, "a", [1e9] * 4)], schema)).count()


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(1)
    entries, queries = rng.normal(0, 300, (256, 16)).astype(np.int64), rng.normal(0, 300, (500, 16)).astype(np.int64)
    va = vector_codes.VAFile(entries)
    lower, upper = va.bounds(queries)
    exact = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (lower <= exact).all() and (exact <= upper).all()
    index, error, refined = va.nearest(queries)
    assert (index == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()
    assert refined < 0.2 * exact.size
    large = rng.integers(-(1 << 26), 1 << 26, (300, 16))
    exact = ((large[:, None] - large[None, :256]) ** 2).sum(axis=2)
    assert (vector_codes.VAFile(large[:256]).nearest(large)[0] == exact.argmin(axis=1)).all()


def test_sums_of_codes_agree_with_spark_order(spark):
    """Codebooks don't depend on how rows are dealt to tasks."""
    df = spark.range(600).select(F.col("id").alias("vec_id"), (F.col("id") % 3).cast("int").alias("label"), F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(8)]).alias("embedding"))
    a, b = (vector_codes.compress(df.repartition(k)).orderBy("vec_id").collect() for k in (1, 7))
    assert a == b
