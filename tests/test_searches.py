"""The answer store across lost runs, and searched distances against a plain search."""

import json
import random

import numpy as np
import pytest

from lodestitch.operators import distances, ends, hierarchy, review
from lodestitch.operators.answers import AnswerStore, SettingsError
from test_sizes import shuffled


upper = lambda prompts: [p.upper() for p in prompts]  # noqa: E731  (sent to workers by value)


def logged(path, poison=""):
    """A model that writes down what it is asked and dies at a poisoned prompt."""

    def model(prompts):
        if poison and any(poison in p for p in prompts):
            raise RuntimeError("the model died")
        with open(path, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return [p.upper() for p in prompts]

    return model


def prompts(spark, n):
    return spark.createDataFrame([(i, f"prompt {i % n}") for i in range(2 * n)] + [(-1, None)], "id long, prompt string")


def test_lost_run_goes_on_after_its_last_chunk(spark, tmp_path):
    asked, log = prompts(spark, 200), tmp_path / "log"
    store = AnswerStore(spark, str(tmp_path / "store"), {"model": "m", "seed": 1})
    # The prompt that kills the model stands in the last chunk or an earlier one: whatever was committed before stays.
    with pytest.raises(Exception, match="the model died"):
        store.fill(asked, logged(log, poison="prompt 77"), chunk=20)
    before = log.read_text().split("\n")[:-1]
    committed = {r.answer.lower() for r in store.answers().collect()}
    assert 0 < len(committed) < 200 and committed <= set(before)
    assert store.manifest().agg({"n_answers": "sum"}).first()[0] == len(committed)
    again = AnswerStore(spark, str(tmp_path / "store"), {"model": "m", "seed": 1})
    assert again.fill(asked, logged(log), chunk=20) == 200 - len(committed)
    after = log.read_text().split("\n")[len(before) : -1]
    assert len(after) == len(set(after)) == 200 - len(committed) and not committed & set(after)
    assert again.fill(asked, logged(log, poison="prompt"), chunk=20) == 0
    got = {(r.id, r.answer) for r in again.attach(asked).collect()}
    assert got == {(i, f"PROMPT {i % 200}") for i in range(400)} | {(-1, None)}


def test_uncommitted_chunks_are_not_read(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "store"))
    assert store.answers().count() == 0 and store.manifest().count() == 0
    store.fill(prompts(spark, 30), upper, chunk=10)
    name = store.chunks()[0]
    store.folder.delete(f"_manifest/{name}.json")
    assert store.missing(prompts(spark, 30)).count() == 30 - store.answers().count() > 0
    assert store.sweep() == [name] and store.sweep() == []
    store.fill(prompts(spark, 30), upper, chunk=10)
    n, whole = len(store.chunks()), sorted(map(tuple, store.answers().collect()))
    store.compact()
    assert n > len(store.chunks()) == 1 and sorted(map(tuple, store.answers().collect())) == whole and len(whole) == 30


def test_runs_at_once_agree(spark, tmp_path):
    """Both runs answered all prompts; every reader sees one answer a prompt, the same one."""
    path = str(tmp_path / "store")
    one, two = AnswerStore(spark, path), AnswerStore(spark, path)
    asked = prompts(spark, 40)
    one.fill(asked, upper, chunk=10)
    two.missing = lambda p: AnswerStore(spark, str(tmp_path / "empty")).missing(p)  # it looked before the other began
    two.fill(asked, lambda ps: [p.title() for p in ps], chunk=15, tasks=2)
    rows = {r.key: r.answer for r in one.answers().collect()}
    assert len(rows) == 40 and rows == {r.key: r.answer for r in AnswerStore(spark, path).answers().collect()}
    two.compact()
    assert rows == {r.key: r.answer for r in one.answers().collect()}


def test_other_settings_are_refused(spark, tmp_path):
    AnswerStore(spark, str(tmp_path / "store"), {"a": 1, "b": 2})
    AnswerStore(spark, str(tmp_path / "store"), {"b": 2, "a": 1})
    with pytest.raises(SettingsError):
        AnswerStore(spark, str(tmp_path / "store"), {"a": 2})
    with pytest.raises(SettingsError):
        review.generate(prompts(spark, 2), upper, "other", str(tmp_path / "store"))


def test_wrong_number_of_answers(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "store"))
    with pytest.raises(Exception, match="got 1 answers"):
        store.fill(prompts(spark, 5), lambda ps: ["x"], chunk=5)
    assert store.chunks() == [] and json.loads(store.folder.text("_settings.json")) == {"settings": ""}


def plain(edges, a, b):
    if a is None or b is None:
        return None
    if a == b:
        return 0
    up = {}
    for p, c in edges:
        if p is not None and c is not None:
            up.setdefault(c, set()).add(p)

    def climb(x):
        found, level = {x: 0}, [x]
        while level:
            level = [p for n in level for p in up.get(n, ()) if found.setdefault(p, found[n] + 1) == found[n] + 1]
        return found

    x, y = climb(a), climb(b)
    return min((x[n] + y[n] for n in x.keys() & y.keys()), default=None)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_distances_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(60)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range((40, 70, 110)[seed - 1])] + [(None, "n1"), ("n2", None), ("n3", "n3"), ("n4", "n5"), ("n5", "n4")]
    edges += [(f"c{i + 1}", f"c{i}") for i in range(12)] + [("c12", "n0")]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(300)] + [("n1", "n1"), ("gone", "gone"), ("gone", "n1"), (None, "n1"), (None, None), ("c0", "c11"), ("c0", "n0")]
    trace = []
    e, p = spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame(pairs, "a string, b string")
    got = list(map(tuple, distances.search(p, e, trace).collect()))
    assert len(got) == len(set(pairs)) and {(a, b): d for a, b, d in got} == {(a, b): plain(edges, a, b) for a, b in set(pairs)}
    assert trace[0]["open"] > trace[-1]["open"]
    whole = hierarchy.distance(p.filter("a IS NOT NULL AND b IS NOT NULL"), e, hierarchy.closure(e))
    assert {tuple(r) for r in whole.collect()} == {x for x in got if x[0] is not None and x[1] is not None}


def test_only_what_open_pairs_need_climbs(spark):
    """Siblings are settled in the first round; a chain of a thousand links above them isn't walked."""
    chain = spark.range(1000).selectExpr("id + 1 AS parent", "id AS child")
    leaves = spark.createDataFrame([(0, -1), (0, -2), (0, -3)], "parent long, child long")
    trace = []
    got = distances.search(spark.createDataFrame([(-1, -2), (-3, -1)], "a long, b long"), chain.unionByName(leaves), trace).collect()
    assert {r.distance for r in got} == {2} and len(trace) == 1 and trace[0]["ancestors"] == 6
    assert distances.search(chain.selectExpr("child AS a", "parent AS b").limit(0), chain).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_ends_equal_a_plain_search(seed, monkeypatch):
    """Cycles, hubs with many children and chains; in halves, and with descents that are given up."""
    monkeypatch.setattr(ends, "MET", 300 if seed % 2 else 4_000_000)
    rnd, n = random.Random(seed), 90
    edges = {(rnd.randrange(max(1, min(i, 10))) if seed < 3 else rnd.randrange(n), i) for i in range(n) for _ in range(2)} | {(i - 1, i) for i in range(60, n)}
    edges = sorted((p, c) for p, c in edges if p != c)
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(400)]
    h = ends.hierarchy(n, np.array([c for _, c in edges]), np.array([p for p, _ in edges]))
    got = ends.distances(h, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])).tolist()
    assert got == [-1 if d is None else d for d in (plain(edges, a, b) for a, b in pairs)]


def test_ways_with_one_long_side_are_found():
    """A chain of which each id has a second parent in a hub's tree far above: the descents must lower what both met first."""
    chain = [(i, i + 1) for i in range(40)]
    over = [(100 + i // 4, 100 + i) for i in range(4, 400)] + [(100 + rnd, i) for i, rnd in enumerate(random.Random(1).choices(range(100, 400), k=41))]
    edges = [(p, c) for p, c in chain + over if p != c]
    h = ends.hierarchy(500, np.array([c for _, c in edges]), np.array([p for p, _ in edges]))
    pairs = [(a, b) for a in range(41) for b in range(41)]
    assert ends.distances(h, *np.array(pairs).T).tolist() == [plain(edges, a, b) for a, b in pairs]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_held_hierarchies_need_no_rounds(spark, kind, monkeypatch):
    n = 3000
    p = spark.range(n).selectExpr("id AS a", f"(id * 5 + 1) % {n} AS b").unionByName(spark.createDataFrame([(5, None), (-7, 3), (-7, -7)], "a long, b long"))
    e = spark.range(n).selectExpr(f"explode(array((id * 7 + 3) % {n}, id div 2)) AS parent", "id AS child")
    p, e = p.selectExpr(*(f"CAST({c} AS {kind}) AS {c}" for c in "ab")), e.selectExpr(*(f"CAST({c} AS {kind}) AS {c}" for c in ("parent", "child")))
    with shuffled(spark, 1_000_000):
        got = {(r.a, r.b): r.distance for r in distances.search(p, e).collect()}
    assert len(got) == n + 3
    monkeypatch.setattr(distances, "EDGES", 0)
    assert got == {(r.a, r.b): r.distance for r in distances.search(p, e).collect()}
