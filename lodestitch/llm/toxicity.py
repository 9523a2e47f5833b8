"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Equal labelled texts count once in the statistics and are one example; of their votes three count at most. The examples are a bounded
sample of them (``max_examples`` a label, by the hash of the text); all their terms are in the index. A term
weighs its IDF, times one plus the gain (log-likelihood ratio) of its presence if it goes with the label, so no
term drops out. Examples are sorted by their leading term and cut into blocks; a block keeps the largest weight
of each term. A query visits blocks by falling upper bound and leaves out those that can't beat its k-th
neighbour: the neighbours are exact. Votes weigh by similarity; a logistic fit to leave-one-out votes of the
examples calibrates them.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, stage

_WORD = re.compile(r"\w+")


def terms(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


class BlockMax:
    """Unit vectors with labels; ``nearest`` gives the exact top ``k`` by cosine."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = 128):
        """``vectors``: the terms and weights of each example."""
        self.n, self.block = len(vectors), block
        self.order = sorted(range(self.n), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1, i))
        n_blocks = -(-self.n // block)
        self.most = np.zeros((n_terms, n_blocks), np.float32)
        none = np.zeros(0)
        t = np.concatenate([none, *(vectors[i][0] for i in self.order)]).astype(np.int64)
        self.at = np.repeat(np.arange(self.n, dtype=np.int32), [len(vectors[i][0]) for i in self.order])
        self.w = np.concatenate([none, *(vectors[i][1] for i in self.order)])
        by_term = np.lexsort((self.at, t))
        t, self.at, self.w = t[by_term], self.at[by_term], self.w[by_term]
        np.maximum.at(self.most, (t, self.at // block), np.nextafter(self.w.astype(np.float32), np.float32(np.inf)))
        cells = np.bincount(t * n_blocks + self.at // block + 1, minlength=n_terms * n_blocks + 1)
        self.first = np.cumsum(cells, dtype=np.int32)
        del cells
        # terms that many examples share are rows of a matrix, the others have postings
        often = np.flatnonzero(np.bincount(t, minlength=n_terms) * 20 >= self.n) if self.n else np.zeros(0, np.int64)
        self.row = np.full(n_terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n_blocks * block), np.float32)
        held = self.row[t] >= 0
        self.dense[self.row[t[held]], self.at[held]] = self.w[held]
        self.order = np.array(self.order, np.int64)
        self.dense = self.dense.reshape(len(often), n_blocks, block)

    def similar(self, t: np.ndarray, w: np.ndarray, blocks: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(-similarity, example) of the examples in ``blocks`` that share a term: the best ``k`` and ties."""
        row = self.row[t]
        held, rare = row >= 0, np.flatnonzero(row < 0)
        sims = np.zeros((self.most.shape[1], self.block))
        if held.any():
            part = self.dense[row[held]] if len(blocks) * 2 > len(sims) else self.dense[row[held][:, None], blocks]
            got = (w[held].astype(np.float32) @ part.reshape(len(part), -1)).reshape(-1, self.block)
            sims[blocks] = got[blocks] if len(got) == len(sims) else got
        cell = (t[rare][:, None] * len(sims) + blocks).ravel()
        n = self.first[cell + 1] - self.first[cell]
        some = np.flatnonzero(n)
        cell, n = cell[some], n[some]
        at = np.repeat(self.first[cell] - np.cumsum(n) + n, n) + np.arange(n.sum())
        sims = sims.ravel() + np.bincount(self.at[at], np.repeat(w[rare[some // len(blocks)]], n) * self.w[at], sims.size)
        least = np.partition(sims, -k)[-k] if k < sims.size else 0.0
        hit = np.flatnonzero((sims > 0) & (sims >= least))
        return [(-x, i) for x, i in zip(sims[hit].tolist(), self.order[hit].tolist(), strict=True)]

    def nearest(self, q: dict[int, float], k: int) -> list[tuple[float, int]]:
        """(similarity, example), best first; ties by the smaller example. Examples without a shared term are left out."""
        if not q or not self.n:
            return []
        t, w = np.fromiter(q, np.int64), np.fromiter(q.values(), np.float64)
        bound = w.astype(np.float32) @ self.most[t]
        left = np.argsort(-bound, kind="stable")
        left = left[bound[left] > 0]
        found: list[tuple[float, int]] = []
        size = 4
        while len(left):
            found = heapq.nsmallest(k, [*found, *self.similar(t, w, left[:size], k)])
            left, size = left[size:], len(left)
            if len(found) >= k:
                left = left[bound[left] * 1.00001 >= -found[-1][0]]
        return [(-s, i) for s, i in found]


class Model:
    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray, float, float]], ids: dict[str, int], weights: np.ndarray, k: int):
        """``examples``: the numbers of an example's terms, their counts, its share of label 1 and its votes."""
        self.ids, self.weights, self.k = ids, weights, k
        groups: dict[bytes, np.ndarray] = {}
        vectors = []
        for t, said, y, n in examples:
            by_term = np.argsort(t)
            t, w = t[by_term], np.round(self.unit(t, said), 6)[by_term]
            group = t.tobytes() + w.tobytes()
            if len(t) and group not in groups:
                vectors.append((t, w))
            groups.setdefault(group, np.zeros(2))[:] += (n * (1 - y), n * y)
        self.bare = groups.pop(b"", np.zeros(2))
        self.votes = np.array(list(groups.values()), float).reshape(-1, 2)
        self.index = BlockMax(vectors, len(weights))
        total = self.votes.sum(0) + self.bare
        self.prior = (total[1] + 0.5) / (total.sum() + 1)
        xs, ys, ws = [], [], []
        for i, v in enumerate(vectors):
            x = self.raw(self.index.nearest(dict(zip(*(a.tolist() for a in v), strict=True)), self.k + 1), i)
            for y in (0, 1):
                if self.votes[i, y]:
                    xs.append(x)
                    ys.append(y)
                    ws.append(self.votes[i, y])
        a, b = 1.0, 0.0
        if len(set(ys)) == 2:
            x, y, w = np.array(xs), np.array(ys), np.array(ws)
            for _ in range(30):  # Newton steps of a logistic fit with a weak pull to (1, 0)
                p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
                g = np.array([(w * (p - y) * x).sum() + (a - 1), (w * (p - y)).sum() + b])
                h = w * p * (1 - p)
                step = np.linalg.solve([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1]], g)
                a, b = a - step[0], b - step[1]
        self.a, self.b = (a, b) if a > 0 else (1.0, 0.0)

    def unit(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.weights[t]
        return w / np.sqrt((w * w).sum())

    def vector(self, said: dict[str, int]) -> dict[int, float]:
        known = [(self.ids[t], n) for t, n in said.items() if t in self.ids]
        t, n = np.array(known, np.int64).reshape(-1, 2).T
        return dict(zip(t.tolist(), self.unit(t, n).tolist(), strict=True))

    def raw(self, near: list[tuple[float, int]], left_out: int = -1) -> float:
        """Log odds of the votes of the nearest examples, with the prior as one vote."""
        up, down = self.prior, 1 - self.prior
        for s, i in [x for x in near if x[1] != left_out][: self.k]:
            neg, pos = self.votes[i]
            w = s**2 * min(3.0, neg + pos) / (neg + pos)
            down, up = down + w * neg, up + w * pos
        return math.log(up / down)

    def score(self, text: str) -> tuple[float, str]:
        v = self.vector(terms(text))
        if not v:
            return (self.bare[1] + self.prior) / (sum(self.bare) + 1), ""
        near = self.index.nearest(v, max(3, self.k))
        said = ",".join(f"{i}:{s:.3f}" for s, i in near[:3])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a * self.raw(near) + self.b)))), said


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, max_rows: int, max_examples: int, k: int) -> Model:
    """A model from the labelled rows whose crc32(key) mod 3 isn't 1: at most ``max_rows`` texts of each label."""
    known = labels.filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1))
    known = known.groupBy(F.col(key).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    every = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    texts = every.select("id", "h").join(known, "id").groupBy("h").agg(F.min("id").alias("id"), F.avg("toxic").alias("share"), F.least(F.count(F.lit(1)), F.lit(3)).cast("double").alias("copies"))
    texts = stage(texts.withColumn("y", (F.col("share") >= 0.5).cast("int")), "toxic-texts")

    def sample(df: DataFrame, n: int) -> DataFrame:
        return df.filter("y = 0").orderBy("h").limit(n).union(df.filter("y = 1").orderBy("h").limit(n))

    rows = stage(every.join(F.broadcast(sample(texts, max_rows)), ["id", "h"]).dropDuplicates(["h"]), "toxic-rows")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [terms(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(x) for x in said], pa.string()), pa.array([list(x.values()) for x in said], pa.list_(pa.int32())), *b.columns[1:]], ["t", "n", "share", "copies"])

    got = sample(rows, max_examples).select("t", "share", "copies").mapInArrow(project, "t string, n array<int>, share double, copies double").orderBy("t", "share", "copies").toArrow()
    ids: dict[str, int] = {}
    examples = [
        (np.array([ids.setdefault(t, len(ids)) for t in got["t"][i].as_py().split()], np.int32), np.array(got["n"][i].as_py(), np.int32), got["share"][i].as_py(), got["copies"][i].as_py())
        for i in range(got.num_rows)
    ]
    del got
    used = docs.sparkSession.sparkContext.broadcast(set(ids))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y].update(set(terms(t)) & used.value)
            found = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([s[t] for t in found], pa.int64()) for s in seen)], ["term", "n0", "n1"])

    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    all0, all1 = size.get(0, 0), size.get(1, 0)
    counts = rows.select("t", "y").mapInArrow(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def weight(n0: int, n1: int) -> float:
        share = (n0 + n1) / (all0 + all1)
        gain = 2 * sum(n * math.log(n / (share * of)) for n, of in ((n0, all0), (n1, all1)) if n)
        return math.log(1 + 1 / share) * (1 + gain * (n1 * all0 > n0 * all1))

    found = counts.toArrow()
    weights = np.zeros(len(ids))
    for t, n0, n1 in zip(*(found[c].to_pylist() for c in ("term", "n0", "n1")), strict=True):
        weights[ids[t]] = weight(n0, n1)
    del found
    used.destroy()
    return Model(examples, ids, weights, k)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7, max_rows: int = 4000, max_examples: int = 1500, k: int = 15) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (nearest examples) per row of ``docs``.

    A null or empty text scores like examples without any term. Without labels every row gets
    the prior, one half. A row labelled twice counts as toxic if one of its labels says so. Repeated rows give
    equal rows, an empty table no rows; extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, max_rows, max_examples, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            got = [m.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.string())], ["doc_id", "score", "evidence"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double, evidence string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def reject(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic; all columns stay. Rows with a null key are judged like others."""
    gone = small_side(stage(score(docs, labels, key=key, **options).filter("predicted = 1").select(F.col("doc_id").alias("gone_id")).distinct(), "toxic-gone"))
    return docs.join(gone, docs[key].eqNullSafe(gone["gone_id"]), "left_anti")
