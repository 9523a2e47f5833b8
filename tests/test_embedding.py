"""The pruned cosine search against all products, and the embedder's contract."""

import duckdb
import numpy as np
import pytest

from lodestitch.operators import embedding


def frame(spark, ids, m):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in zip(ids, m, strict=True)], "id long, v array<double>")


def products(a, b, threshold):
    a, b = (embedding._unit(np.asarray(x)) for x in (a, b))
    return {(i, j) for i, j in zip(*np.nonzero(a @ b.T > threshold), strict=True)}


def clustered(rng, n, dims=24):
    centres = rng.normal(size=(6, dims)) * 4
    return centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * 0.3


@pytest.mark.parametrize(("kind", "threshold"), [("clustered", 0.9), ("random", 0.3), ("opposite", -0.5)])
def test_nothing_is_lost(spark, monkeypatch, kind, threshold):
    monkeypatch.setattr(embedding, "BLOCK", 16)
    monkeypatch.setattr(embedding, "BROADCAST_BYTES", 0 if kind == "random" else 1 << 20)
    rng = np.random.default_rng(4)
    make = clustered if kind == "clustered" else lambda r, n, dims=24: r.normal(size=(n, dims))
    x, y = make(rng, 260), make(rng, 200)
    y[:5], x[3], y[7] = x[:5] * 3, 0, 0
    got = embedding.cosine_join(frame(spark, range(260), x), frame(spark, range(200), y), threshold).collect()
    assert len(got) == len({(r.hpo_id, r.sct_id) for r in got}) and {(r.hpo_id, r.sct_id) for r in got} == {p for p in products(x, y, threshold) if p[0] != 3 and p[1] != 7}
    own = {(r.hpo_id, r.sct_id) for r in embedding.cosine_self_join(frame(spark, range(260), x), threshold).collect()}
    assert own == {(i, j) for i, j in products(x, x, threshold) if i < j and 3 not in (i, j)}


def test_far_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 16)
    x = clustered(np.random.default_rng(4), 600)
    far = embedding.skipped(frame(spark, range(600), x), threshold=0.9).first()
    assert far.n_skipped / far.n_block_pairs == far.skipped_share > 0.6
    none = embedding.skipped(frame(spark, range(600), x), threshold=-1.0).first()
    assert none.n_skipped == 0 < none.n_block_pairs
    assert embedding.skipped(frame(spark, [], [])).first().skipped_share == 0


def test_bounds_never_exceed_angles():
    rng = np.random.default_rng(2)
    points = embedding._unit(rng.normal(size=(5, 6)))
    x = embedding._unit(np.concatenate([rng.normal(size=(300, 6)), points, -points]))
    angle = np.arccos(np.clip((x @ points.T).astype(float), -1, 1))
    pivot = angle.argmin(axis=1)
    own = angle[np.arange(len(x)), pivot]
    shell = (own * 8).astype(int)
    keys = sorted({(int(p), int(s)) for p, s in zip(pivot, shell, strict=True)})
    inside = [np.flatnonzero((pivot == p) & (shell == s)) for p, s in keys]
    found = [embedding.Group(p, s, len(i), own[i].min(), own[i].max()) for (p, s), i in zip(keys, inside, strict=True)]
    least = embedding.least_angles(found, found, points)
    between = np.arccos(np.clip((x @ x.T).astype(float), -1, 1))
    assert all(least[a, b] <= between[np.ix_(inside[a], inside[b])].min() for a in range(len(keys)) for b in range(len(keys)))
    assert (least > 0.1).any()


def test_embedder_asks_each_text_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def model(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        assert len(texts) <= 3
        return np.array([[t.count(c) for c in "abc"] for t in texts], float)

    terms = [("h1", "aab"), ("h2", "aab"), ("h2", "zzz"), ("h3", None), ("h4", "abc"), *((f"x{i}", "c" * (i + 1)) for i in range(9))]
    df = spark.createDataFrame(terms, "concept_id string, term string")
    got = {(r.concept_id, r.term): r.v for r in embedding.TermEmbedder(model, 3).embed(df).collect()}
    assert len(got) == len(terms) and got["h3", None] is None and got["h2", "zzz"] == [0, 0, 0] and got["x8", "c" * 9] == [0, 0, 1]
    asked = open(log).read().split()
    assert sorted(asked) == sorted({t for _, t in terms if t})
    pairs = embedding.embedding_pairs(df.filter("concept_id IN ('h1', 'h2', 'h3')"), df.filter("concept_id IN ('h4', 'x0')"), embedding.TermEmbedder(model, 3), 0.7)
    assert [tuple(r) for r in pairs.orderBy("hpo_id").collect()] == [("h1", "h4", "embedding", 0.774597), ("h2", "h4", "embedding", 0.774597)]


def test_confidences_are_those_of_doubles(spark):
    x = np.random.default_rng(8).normal(size=(400, 64)).astype(np.float32)
    m = x.astype(np.float64)
    c = m @ m.T / np.sqrt(np.outer((m * m).sum(axis=1), (m * m).sum(axis=1)))
    got = embedding.cosine_self_join(frame(spark, range(400), x), 0.0).collect()
    assert len(got) > 30_000 and all(r.confidence == round(min(c[r.hpo_id, r.sct_id], 1.0), 6) for r in got)


def test_four_places_by_binary_value(spark):
    from lodestitch.plans.alignment import _four_places

    values = [i / 1e6 for i in range(300_050, 400_000, 100)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "c double").select(_four_places("c")).collect()]
    want = [r[0] for r in duckdb.sql(f"SELECT round(v, 4) FROM (SELECT unnest({values}::DOUBLE[]) AS v)").fetchall()]
    assert got == want


def test_pairs_at_the_threshold_are_those_of_sql(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodestitch.plans import alignment

    # Two directions apart by about the angle of 0.3, turned together and scaled, so that rounding decides.
    rng = np.random.default_rng(5)
    u, w = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    x = [u * s for s in rng.uniform(0.5, 2, 60)] + [(0.3 * u + np.sqrt(1 - 0.09) * w) * s for s in rng.uniform(0.5, 2, 60)]
    frame(spark, range(120), x).select(F.col("id").alias("vec_id"), F.col("v").cast("array<float>").alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in alignment.cosine_pairs_all(spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = set(con.execute(alignment.ORACLE_SQL["cosine_pairs_all"]).fetchall())
    near = {p for p in want if p[0] < 60 <= p[1]}
    assert got == want and 0 < len(near) < 3600


def test_blocks_move_once_a_tile_and_pairs_not_at_all(spark, monkeypatch):
    from test_sizes import shuffled

    monkeypatch.setattr(embedding, "BLOCK", 16)
    monkeypatch.setattr(embedding, "TILE", 8, raising=False)
    monkeypatch.setattr(embedding, "BROADCAST_BYTES", 0)
    x = np.random.default_rng(4).normal(size=(1500, 24))
    want = {(i, j) for i, j in products(x, x, 0.2) if i < j}
    df = frame(spark, range(1500), x).cache()
    with shuffled(spark, 4_000_000):
        got = [(r.hpo_id, r.sct_id) for r in embedding.cosine_self_join(df, 0.2).collect()]
    assert len(got) == len(want) > 100_000 and set(got) == want
    twice = df.unionByName(df.filter("id < 10").selectExpr("id", "transform(v, e -> -e) AS v"))
    pairs = [(r.hpo_id, r.sct_id) for r in embedding.cosine_self_join(twice, 0.2).collect()]
    both = want | {(i, j) for i in range(10) for j in range(i + 1, 1500) if (-x[i] @ x[j] * (1 if j > 9 else np.inf)) / np.sqrt(x[i] @ x[i] * (x[j] @ x[j])) > 0.2}
    assert len(pairs) == len(set(pairs)) and {p for p in pairs if p[1] > 9} == {p for p in both if p[1] > 9}
