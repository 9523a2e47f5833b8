"""Word models: interpolated modified Kneser-Ney (quality) and a probabilistic suffix tree (scores).

Words are hashed to 64 bits (A-Z lower-cased); an end closes each text, and a start stands before its first word.
The Kneser-Ney model is fitted to all trusted rows that aren't held out, the suffix tree to all rows but those:
positions are dealt by the word before them, packed into one binary row per chunk and range of hashes, so that all
contexts that end in a word, of any length, meet in one task and no row is made for a token (``Deal``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stage
from .jaccard import _chunks, _kind, _texts, mix, word_hashes

_END, _START = np.uint64(0xE4D), np.uint64(0x57A27)
_HIGH = np.uint64(1) << np.uint64(63)
_SALT, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts in turn (words, then one end each), and the number of tokens of each text."""
    words, counts, at = [], [], 0
    while at < len(texts):  # some at a time: hashing takes many times a text's memory
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= 250_000):
            size += len(texts[to])
            to += 1
        w, n = word_hashes(texts[at:to])
        words.append(np.insert(w, np.cumsum(n), _END))
        counts.append(n + 1)
        at = to
    return (np.concatenate(words), np.concatenate(counts)) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def before(t: np.ndarray, n: np.ndarray, depth: int, start: np.uint64 = _START) -> list[np.ndarray]:
    """The words 1, 2, ... ``depth`` places before each token of its text; the start where there is none."""
    place = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
    out = []
    for d in range(1, depth + 1):
        c = np.full(len(t), start)
        if len(t) > d:
            c[d:] = np.where(place[d:] >= d, t[:-d], start)
        out.append(c)
    return out


def _crc_rest(key: str, mod: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod, F.lit(-1))


# ---- Kneser-Ney


def discounts(counts: np.ndarray) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and 3 or more from the counts of counts; 0.5, 1, 1.5 where some are missing."""
    n1, n2, n3, n4 = (int((counts == i).sum()) for i in range(1, 5))
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return np.array([0.0, *(min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1))])


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float | np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    if len(keys) > 1 << 16:  # in order, as the keys don't fit the processor's caches
        order = np.argsort(wanted)
        at = np.empty(len(wanted), np.int64)
        at[order] = np.searchsorted(keys, wanted[order])
    else:
        at = np.searchsorted(keys, wanted)
    at = np.minimum(at, len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``h``, and where its runs of equal values begin there."""
    order = np.argsort(h)
    s = h[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])))


def _dense(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each of ``h``, equal ones having the same, and a place of each number."""
    order, first = _runs(h)
    out = np.empty(len(h), np.int64)
    out[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    return out, order[first]


def _among(words: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which of ``c`` are among the few ``words``, nearly all of which are small numbers."""
    out = np.isin(c, words[words < _HIGH], kind="table")
    for x in words[words >= _HIGH]:
        out |= c == x
    return out


class KneserNey:
    """Interpolated modified Kneser-Ney of any order over texts in memory; ``score`` gives natural logs of the tokens' probabilities."""

    def __init__(self, t: np.ndarray, n: np.ndarray, order: int):
        self.order = order
        ctx, grams = self.hashes(t, n)
        self.levels: list[tuple[np.ndarray, ...]] = [None] * order  # type: ignore[list-item]
        self.types = 0
        g, first, count = np.unique(grams[-1], return_index=True, return_counts=True)
        for j in range(order - 1, -1, -1):
            where = ctx[j][first]
            d = discounts(count)[np.minimum(count, 3)]
            c, inverse = np.unique(where, return_inverse=True)
            total = np.bincount(inverse, count, len(c))
            self.levels[j] = (g, ((count - d) / total[inverse]).astype(np.float32), c, (np.bincount(inverse, d, len(c)) / total).astype(np.float32))
            if j:  # the next lower order counts the different words before an n-gram
                g, at, count = np.unique(grams[j - 1][first], return_index=True, return_counts=True)
                first = first[at]
            else:
                self.types = len(g)

    def hashes(self, t: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ctx = [np.zeros(len(t), np.uint64)]
        for c in before(t, n, self.order - 1):
            ctx.append(mix(ctx[-1] * _SALT + c))
        return ctx, [mix(x * _LAST + t) for x in ctx]

    def score(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = np.full(len(t), 1.0 / (self.types + 1))
        for c, g, (keys, share, ctx, left) in zip(*self.hashes(t, n), self.levels, strict=True):
            p = _look(keys, share, g, 0.0) + _look(ctx, left, c, 1.0) * p
        return np.log(p)


def _levels(ctx: list[np.ndarray], w: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of the contexts of 0, 1, ... words and of these with the token."""
    c = [np.zeros(len(w), np.uint64)]
    for x in ctx[: order - 1]:
        c.append(mix(c[-1] * _SALT + x))
    return c, [mix(x * _LAST + w) for x in c]


def _grams(grams: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order, lowest first, the different n-grams, a place of each, and its count: how often it was met in the highest
    order, how many different words stand before it in the others."""
    out, first = [], None
    for g in reversed(grams):
        g = g if first is None else g[first]
        order, at = _runs(g)
        first = order[at] if first is None else first[order[at]]
        out.append((g[order[at]], first, np.diff(np.append(at, len(g)))))
    return out[::-1]


def _cut(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return d[np.minimum(count, 3).astype(np.int64)]


def kneser_ney(
    docs: DataFrame,
    trusted: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = 3,
    quantile: float = 0.98,
    factor: float = 1.0,
    n_top: int = 1 << 18,
    chunk: int = 8_000_000,
    hot_share: float = 1 / 1024,
    waves: int = 3,
) -> DataFrame:
    """Kneser-Ney of ``order`` words: doc_id, lang, n_tokens, perplexity, threshold, kept.

    ``trusted`` holds the ids of trusted rows in ``key``. The model is fitted to all of those whose crc32(id) mod 4
    isn't 3. A language's threshold is ``factor`` times the ``quantile`` of the perplexities of its other trusted rows, of
    all trusted rows where it has none (or is null); without trusted rows all are kept. Null texts are empty (one end).
    Repeated rows are learned and scored one by one, an empty table gives no rows, extra columns are ignored, a null
    key stays null, a string key stays a string. A very long text is a chunk of its own.

    The trusted positions are dealt by the word before them and counted; then all positions are dealt with them, so
    that a bucket has all n-grams of its contexts. Buckets pass in ``waves`` for the disk. Counts of single words and of
    pairs of a word of more than ``hot_share`` of all tokens are sent to all tasks for the ``n_top`` most frequent ones,
    else told to the buckets that ask for them: results depend on neither number.
    """
    spark = docs.sparkSession
    kind = _kind(_texts(docs, key, text))
    ids = trusted.select(F.col(key).cast(kind).alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    ids = stage(ids.select("doc_id", (_crc_rest("doc_id", 4) != 3).alias("learn")), "kn-trusted")
    taught = ids.filter("learn")
    small = taught.limit(1_000_001).count() <= 1_000_000
    own = F.col(key) if kind == "string" else F.col(key).cast("long")
    whole = docs.select(own.alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"), F.col(lang).cast("string").alias("extra"))
    rows = whole.join(F.broadcast(taught) if small else taught, "doc_id", "left").withColumn("learn", F.coalesce("learn", F.lit(False)))
    rows = rows.select("doc_id", "text", "learn", "extra")
    if not small:  # once, as the texts move
        rows = stage(rows, "kn-rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, ts in _chunks([b], chunk // 2):
                w, c = np.unique(tokens(ts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["w", "c"])

    words = stage(rows.filter("learn").mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "kn-words")
    v = Vocabulary(words, n_top)
    ends = int(words.filter(F.col("w") == int(_END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    hot_size = v.hot(hot_share, ends) if order > 1 else {}
    hot_words = np.array(sorted(hot_size), np.uint64)
    depth = max(1, order - 1)
    none = np.zeros(0, np.uint64)
    learned = Deal(rows, depth, chunk, v.ranked, hot_words, none)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kind, a, w, c): 0 words, 1 pairs of hot words, 2 how many n-grams of order ``a`` have the count ``w`` (4: more)."""
        for _, got in learned.each(batches):
            if got is None:
                continue
            ctx, w = got[3], got[4]
            hot = _among(hot_words, ctx[0])
            levels = _grams(_levels(ctx, w, order)[1])
            out = []
            for j in range(1, order):
                at, c = levels[j][1:]
                if j == 1:
                    out.append((1, ctx[0][at[hot[at]]], w[at[hot[at]]], c[hot[at]]))
                    c = c[~hot[at]]
                seen, n = np.unique(np.minimum(c, 5), return_counts=True)
                out.append((2, np.full(len(seen), j, np.uint64), seen.astype(np.uint64), n))
            # a hot pair may be met in several buckets: it counts for its word once, when its parts are summed
            at = levels[1][1] if order > 1 else np.arange(len(w))
            mine, n = np.unique(w[at[~hot[at]]], return_counts=True)
            out.append((0, np.zeros(len(mine), np.uint64), mine, n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in out])), *(pa.array(np.concatenate([x[i] for x in out]).astype(np.uint64).view(np.int64)) for i in (1, 2, 3))], ["kind", "a", "w", "c"]
            )

    train = rows.filter("learn").mapInArrow(learned.deal, learned.schema).repartitionById(learned.parts, F.col("part")).sortWithinPartitions("bucket", "chunk")
    sums = stage(train.mapInArrow(counted, "kind int, a long, w long, c long").groupBy("kind", "a", "w").agg(F.sum("c").alias("c")), "kn-counts")
    pairs = sums.filter("kind = 1").select("a", "w", "c")
    first = stage(sums.filter("kind = 0").select("w", "c").unionByName(pairs.select("w", F.lit(1).cast("long").alias("c"))).groupBy("w").agg(F.sum("c").alias("c")), "kn-first")
    # how many n-grams of each order have the counts 1 to 4, or more
    met = np.zeros((order, 6), np.int64)
    few = F.least("c", F.lit(5))
    for r in sums.filter("kind = 2").collect():
        met[r["a"], r["w"]] += r["c"]
    for j, df in ((0, first), *(((1, pairs),) if order > 1 else ())):
        for r in df.groupBy(few.alias("w")).count().collect():
            met[j, r["w"]] += r["count"]
    cuts = [discounts(np.repeat(np.arange(5), m[:5])) for m in met]
    n_first, types = (int(x or 0) for x in first.agg(F.sum("c"), F.count(F.lit(1))).first())
    left_first = float((met[0] * _cut(cuts[0], np.arange(6))).sum() / max(n_first, 1))
    at_rank = first.filter("w >= 0").toArrow()
    often = np.zeros(len(v.ranked), np.int64)
    often[at_rank["w"].to_numpy()] = at_rank["c"].to_numpy()
    stats: dict[int, list[float]] = {}
    for r in pairs.groupBy("a", F.least("c", F.lit(3)).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        s = stats.setdefault(int(r["a"]) & ((1 << 64) - 1), [0.0, 0.0])
        s[0], s[1] = s[0] + r["c"], s[1] + r["n"] * cuts[1][r["k"]]
    hot_total = np.array([stats.get(int(x), (0.0, 0.0))[0] for x in hot_words])
    hot_left = np.array([stats.get(int(x), (0.0, 0.0))[1] for x in hot_words]) / np.maximum(hot_total, 1)
    least = most(pairs, 4 * n_top)
    got = pairs.filter(F.col("c") >= least).toArrow()
    at_hand = pair_keys(*(got[x].to_numpy().astype(np.int64).view(np.uint64) for x in ("a", "w")))
    sent = spark.sparkContext.broadcast((often, Told(at_hand, got["c"].to_numpy())))
    counts = first.filter("w < 0").select(F.lit(-1).cast("long").alias("a"), "w", "c").unionByName(pairs.filter(F.col("c") < least))

    def score(ctx: list[np.ndarray], w: np.ndarray, taught: np.ndarray, told: Told) -> tuple[np.ndarray, ...]:
        own, frequent = sent.value
        contexts, grams = _levels(ctx, w, order)
        levels, learned = _grams([g[taught] for g in grams]), [c[taught] for c in contexts]
        c = _counts(own, w, told)
        p = (c - _cut(cuts[0], c)) / n_first + left_first / (types + 1)
        hot = _among(hot_words, ctx[0])
        for j in range(1, order):
            keys, at, count = levels[j]
            d = _cut(cuts[j], count)
            of, inverse = np.unique(learned[j][at], return_inverse=True)
            total = np.bincount(inverse, count, len(of))
            left = np.bincount(inverse, d, len(of)) / total
            below, p = p, _look(keys, (count - d) / total[inverse], grams[j], 0.0) + _look(of, left, contexts[j], 1.0) * p
            if j == 1 and hot.any():
                a, x = ctx[0][hot], w[hot]
                of = np.searchsorted(hot_words, a)
                c = frequent.count(a, x) + told.count(a, x)
                p[hot] = np.where(hot_total[of] > 0, (c - _cut(cuts[1], c)) / np.maximum(hot_total[of], 1) + hot_left[of] * below[hot], below[hot])
        return (np.log(p),)

    if types:
        done = stage(Deal(rows, depth, chunk, v.ranked, hot_words, at_hand, 2 * waves).summed(rows, counts, score, [np.float64], waves), "kn-scored")
    else:  # nothing to learn from: sizes alone

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = 0
                for keys, ts in _chunks([b], chunk):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(keys)), b.column(3).slice(at, len(keys)), pa.array(tokens(ts)[1], pa.int64())], ["doc_id", "extra", "n_tokens"])
                    at += len(keys)

        done = stage(rows.mapInArrow(sizes, f"doc_id {kind}, extra string, n_tokens long"), "kn-scored").withColumn("v0", F.lit(None).cast("double"))
    scored = done.select("doc_id", F.col("extra").alias("lang"), "n_tokens", F.exp(-F.col("v0") / F.col("n_tokens")).alias("perplexity"))
    good = scored.join(small_side(ids.filter("NOT learn").select("doc_id")), "doc_id", "left_semi")
    by = good.groupBy("lang").agg((F.percentile_approx("perplexity", quantile, 10_000) * factor).alias("own")).filter("lang is not null")
    every = good.agg(F.percentile_approx("perplexity", quantile, 10_000) * factor).first()[0]
    limit = F.coalesce(F.col("own"), F.lit(every).cast("double"), F.lit(float("inf")))
    kept = F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return scored.join(by, "lang", "left").select("doc_id", "lang", "n_tokens", "perplexity", F.when(F.col("perplexity").isNotNull(), limit).alias("threshold"), kept.alias("kept"))


# ---- suffix tree


#: Stands in place of a context where a word's own count is asked for.
_ROOT = np.uint64(0xFFFFFFFFFFFFFFFF)


def pack(*columns: np.ndarray) -> bytes:
    """Byte planes, compressed: the small numbers of frequent words leave planes of zeros."""
    return pa.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), "zstd", asbytes=True)


def unpack(blob: bytes, n: int, kinds: list) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, n * sum(np.dtype(k).itemsize for k in kinds), "zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for k in kinds:
        wide = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, n).T).view(k).ravel())
        at += n * wide
    return out


def narrow(t: np.ndarray) -> np.ndarray:
    """40 bits of the hashes of rare words further before; a token and the word before it keep all 64, as their counts must be exact."""
    return np.where((t >> np.uint64(32) == 0) | (t == _HIGH), t, t & np.uint64((1 << 40) - 1) | np.uint64(1 << 40))


def pair_keys(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(a * _LAST + w)


class Told:
    """Counts by context (a hot word, or none) and word, of those a bucket asked for; 0 of what nothing is known."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def count(self, a: np.ndarray, w: np.ndarray) -> np.ndarray:
        return _look(self.keys, self.counts, pair_keys(a, w), 0)


class Root:
    """The root's distribution: add-one over all words. The counts of the frequent words, which are numbered by
    frequency, are at hand; those of the others are told."""

    def __init__(self, count: np.ndarray, n: int, v: int):
        self.count, self.all = count, n + v + 1

    def probability(self, w: np.ndarray, told: Told) -> np.ndarray:
        return (_counts(self.count, w, told) + 1.0) / self.all


def _counts(often: np.ndarray, w: np.ndarray, told: Told) -> np.ndarray:
    """The words' own counts, of numbered ones from ``often``."""
    known = w < np.uint64(len(often))
    out = np.zeros(len(w))
    out[known] = often[w[known].astype(np.int64)]
    out[~known] = told.count(np.full(int((~known).sum()), _ROOT), w[~known])
    return out


class Hot:
    """Next tokens of the words that are too frequent for one task: the pairs met at least ``min_count`` times, and the root
    for the rest. The most frequent pairs are at hand, the others are told."""

    def __init__(self, size: dict[int, int], paired: dict[int, int], first: np.ndarray, second: np.ndarray, count: np.ndarray):
        self.words = np.array(sorted(size), np.uint64)
        self.size = np.array([size[int(w)] for w in self.words], float)
        self.often = Told(pair_keys(first, second), count)
        self.left = 1.0 - np.array([paired.get(int(w), 0) for w in self.words], float) / np.maximum(self.size, 1)

    def among(self, c: np.ndarray) -> np.ndarray:
        return _among(self.words, c)

    def apply(self, c: np.ndarray, w: np.ndarray, p: np.ndarray, told: Told) -> np.ndarray:
        of = np.searchsorted(self.words, c)
        return (self.often.count(c, w) + told.count(c, w)) / self.size[of] + self.left[of] * p


class Deal:
    """Deals the positions of texts by the word before them, packed into one binary row per chunk and bucket of words.

    ``rows`` are (doc_id, text, learn, extra): ``learn`` marks texts to learn from. Words are numbered by ``ranked``, the hashes of frequent words, most frequent first; all others keep their
    hash. Positions after ``hot`` words are dealt by the word before that too. A bucket is told the counts (a, w, c) of
    what it asks for: those of its words without a number, and of its pairs of a hot word that aren't ``at_hand``. A
    partition has ``share`` buckets.
    """

    def __init__(self, rows: DataFrame, depth: int, chunk: int, ranked: np.ndarray, hot: np.ndarray, at_hand: np.ndarray, share: int = 4):
        spark = rows.sparkSession
        self.kind, self.depth, self.chunk, self.hot = _kind(rows), depth, chunk, hot
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = share * self.parts
        self.slots = None
        by_hash = np.argsort(ranked)
        self.ranks = spark.sparkContext.broadcast((ranked[by_hash], by_hash.astype(np.uint64)))
        self.at_hand = spark.sparkContext.broadcast(np.sort(at_hand))
        id_type = pa.string() if self.kind == "string" else pa.int64()
        self.id_type = id_type
        self.schema = f"part int, bucket int, chunk long, n int, blob binary, ids array<{self.kind}>, flags array<int>, sizes array<long>, extra array<string>"
        self.names = ["part", "bucket", "chunk", "n", "blob", "ids", "flags", "sizes", "extra"]
        self.types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())]

    def table(self, rows_out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_out, strict=True), self.types, strict=True)], self.names)

    def number(self, t: np.ndarray) -> np.ndarray:
        keys, ranks = self.ranks.value
        if not len(keys):
            return t | _HIGH
        if self.slots is None:  # by the upper bits; of the words of one slot the most frequent has it, the others are searched
            shift = np.uint64(61 - len(keys).bit_length())
            slot = keys >> shift
            order = np.argsort(ranks)[::-1]
            of, rank = (np.zeros(8 << len(keys).bit_length(), k) for k in (np.uint64, np.uint32))
            of[slot[order]], rank[slot[order]] = keys[order], ranks[order]
            shared = of[slot] != keys
            self.slots = shift, of, rank, keys[shared], ranks[shared]
        shift, of, rank, keys, ranks = self.slots
        slot = (t >> shift).view(np.int64)
        out = rank.take(slot).astype(np.uint64)
        other = np.flatnonzero(of.take(slot) != t)
        out[other] = _look(keys, ranks, t[other], _HIGH | t[other])
        return out

    def places(self, texts: list[bytes], depth: int | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Tokens, the texts' numbers of tokens, the words before each token, whole, and a hash that its bucket comes from,
        for which a ``depth`` of two words is enough."""
        t, n = tokens(texts)
        t = self.number(t)
        lead = before(t, n, min(self.depth, depth or self.depth), _HIGH)
        h = mix(lead[0] + _SALT)
        if len(self.hot):
            at = np.flatnonzero(_among(self.hot, lead[0]))
            second = lead[min(1, self.depth - 1)][at]
            h[at] = mix(h[at] + (narrow(second) if self.depth > 1 else second))
        return t, n, lead, h

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)

    def pairs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per chunk the pairs of a hot word and a word, counted."""
        for b in batches:
            for _, ts in _chunks([b], self.chunk):
                t, n = tokens(ts)
                t = self.number(t)
                lead = before(t, n, 1, _HIGH)
                at = np.flatnonzero(_among(self.hot, lead[0]))
                if len(at):
                    yield _counted(lead[0][at], t[at])

    def by_key(self, keys: np.ndarray, chunk: int, *columns: np.ndarray) -> list[tuple]:
        """Rows of sorted keys and what belongs to them, cut by ranges of the keys."""
        h = self.bucket(keys)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
        return [(int(h[i]) % self.parts, int(h[i]), chunk, int(j - i), pack(*(c[i:j] for c in (keys, *columns))), None, None, None, None) for i, j in zip(first, np.append(first[1:], len(h)), strict=True)]

    def asked(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per chunk the keys that its buckets ask for."""
        known = self.at_hand.value
        for b in batches:
            for _, ts in _chunks([b], self.chunk):
                t, _, lead, h = self.places(ts, 2)
                of, c = self.bucket(h).astype(np.uint32), lead[0]
                rare = np.flatnonzero(t >= _HIGH)
                keys, of_keys = [pair_keys(np.full(len(rare), _ROOT), t[rare])], [of[rare]]
                if len(self.hot):
                    at = np.flatnonzero(_among(self.hot, c))
                    k = pair_keys(c[at], t[at])
                    new = _look(known, np.ones(len(known)), k, 0) == 0
                    keys.append(k[new])
                    of_keys.append(of[at[new]])
                keys, of_keys = np.concatenate(keys), np.concatenate(of_keys)
                # by the upper bits, then by bucket: a key asked for twice may stay twice where these bits are another's too
                low = np.uint64((1 << self.buckets.bit_length()) - 1)
                order = np.argsort(keys & ~low | of_keys)
                keys, of_keys = keys[order], of_keys[order]
                once = np.concatenate((np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (of_keys[1:] != of_keys[:-1])))
                if once.any():
                    yield self.table(self.by_key(keys[once], 0, of_keys[once]))

    def counts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = [], 0
        for b in batches:
            if b.num_rows:
                a, w, c = (x.to_numpy() for x in b.columns)
                got.append((pair_keys(a.view(np.uint64), w.view(np.uint64)), c))
                n += b.num_rows
            if n >= 1_000_000:
                keys, c = _by_first(got)
                yield self.table(self.by_key(keys, -1, c))
                got, n = [], 0
        if got:
            keys, c = _by_first(got)
            yield self.table(self.by_key(keys, -1, c))

    def answer(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each bucket is told of the keys it asks for, range of keys by range."""
        now, have, want = -1, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if have and want:
                keys, c = _by_first(have)
                k, of = (np.concatenate(x) for x in zip(*want, strict=True))
                met = _look(keys, c, k, 0)
                order = np.flatnonzero(met)
                order = order[np.lexsort((k[order], of[order]))]
                k, of, met = k[order], of[order].astype(np.int64), met[order].astype(np.int64)
                new = np.concatenate((np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (of[1:] != of[:-1])))
                k, of, met = k[new], of[new], met[new]
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), of[1:] != of[:-1])))
                if len(first):
                    yield self.table([(int(of[i]) % self.parts, int(of[i]), -1, int(j - i), pack(k[i:j], met[i:j]), None, None, None, None) for i, j in zip(first, np.append(first[1:], len(of)), strict=True)])

        for b in batches:
            for bucket, of, n, blob in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                if bucket != now:
                    yield from out()
                    now, have, want = bucket, [], []
                if of < 0:
                    have.append(tuple(unpack(blob, n, [np.uint64, np.int64])))
                else:
                    want.append(tuple(unpack(blob, n, [np.uint64, np.uint32])))
        yield from out()

    def deal(self, batches: Iterator[pa.RecordBatch], wave: int = 0, waves: int = 1) -> Iterator[pa.RecordBatch]:
        """The positions of the buckets of a wave, and the heads of chunks."""
        from pyspark import TaskContext

        here = TaskContext.get().partitionId() << 32
        for b in batches:
            at = 0
            for keys, ts in _chunks([b], self.chunk):
                learn, extra = (b.column(i).slice(at, len(keys)) for i in (2, 3))
                flags = learn.to_numpy(zero_copy_only=False).astype(np.uint8)
                at += len(keys)
                t, n, lead, h = self.places(ts)
                cols = [*lead, t, np.repeat(np.arange(len(n), dtype=np.uint32), n), np.repeat(flags, n)]
                if waves > 1:
                    at_all = np.flatnonzero(self.bucket(h) // np.uint64(self.parts) % np.uint64(waves) == wave)
                    h, cols = h[at_all], [c[at_all] for c in cols]
                h = self.bucket(h).astype(np.uint16 if self.buckets <= 1 << 16 else np.uint32)
                order = np.argsort(h, kind="stable")  # owners stay in turn
                h = h[order]
                cols = [c[order] for c in cols]
                cols[1 : self.depth] = map(narrow, cols[1 : self.depth])
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
                owner = cols[-2]
                cols[-2] = np.diff(owner, prepend=np.uint32(0))
                cols[-2][first] = owner[first]
                out = [(int(here >> 32) % self.parts, -1, here, len(n), None, keys, flags.tolist(), n.tolist(), extra.to_pylist())]
                for i, j in zip(first, np.append(first[1:], len(h)), strict=True):
                    out.append((int(h[i]) % self.parts, int(h[i]), here, int(j - i), pack(*(c[i:j] for c in cols)), None, None, None, None))
                yield self.table(out)
                here += 1

    def buckets_of(self, rows: DataFrame, counts: DataFrame, waves: int = 1) -> Iterator[DataFrame]:
        """Wave by wave the dealt positions and what the buckets are told, each bucket in one partition, in order."""
        in_turn = lambda df: df.repartitionById(self.parts, F.col("part")).sortWithinPartitions("bucket", "chunk")
        told = in_turn(rows.mapInArrow(self.asked, self.schema).unionByName(counts.select("a", "w", "c").mapInArrow(self.counts, self.schema))).mapInArrow(self.answer, self.schema)
        told = stage(told, "told")
        for i in range(waves):
            yield in_turn(rows.mapInArrow(partial(self.deal, wave=i, waves=waves), self.schema).unionByName(told.filter(F.pmod(F.floor(F.col("bucket") / self.parts), F.lit(waves)) == i)))

    def each(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Per bucket the chunks, owners, flags, words before, words and ``Told``; the heads of chunks as they come."""
        record = [*([np.uint64] * (self.depth + 1)), np.uint32, np.uint8]
        now, held, told = -1, [], []

        def whole() -> tuple:
            cols = [np.concatenate(x) for x in zip(*(x[1:] for x in held), strict=True)]
            chunk_of = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) for x in held])
            say = Told(*(np.concatenate(x) for x in zip(*told, strict=True))) if told else Told(np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return chunk_of, cols[-2], cols[-1], cols[: self.depth], cols[self.depth], say

        for b in batches:
            for _, bucket, of, n, blob, ids, flags, sizes, extra in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if bucket < 0:
                    yield self.table([(of % self.parts, -1, of, n, None, ids, flags, sizes, extra)]), None
                    continue
                if bucket != now:
                    if held:
                        yield None, whole()
                    held, told = [], []
                now = bucket
                if of < 0:
                    told.append(unpack(blob, n, [np.uint64, np.int64]))
                else:
                    cols = unpack(blob, n, record)
                    cols[-2] = np.cumsum(cols[-2], dtype=np.uint32)
                    held.append((of, *cols))
        if held:
            yield None, whole()

    def summed(self, rows: DataFrame, counts: DataFrame, score, kinds: list, waves: int = 1) -> DataFrame:
        """(doc_id, learn, n_tokens, extra, v0, ...): of each of the texts ``rows`` the sums of what ``score`` gives its tokens.

        ``score(ctx, w, taught, told)`` gives one array per kind; ``ctx`` are the words before, nearest first. Of several
        ``waves`` each has a part of the buckets, so that positions are moved once in all and each wave leaves its sums.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: list[tuple[np.ndarray, ...]] = []

            def added(c: np.ndarray, o: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
                """Neighbours of one chunk and owner, summed."""
                at = np.flatnonzero(np.concatenate((np.ones(min(1, len(c)), bool), (c[1:] != c[:-1]) | (o[1:] != o[:-1]))))
                return c[at], o[at], *(np.add.reduceat(v, at) if len(at) else v for v in values)

            def merged() -> tuple[np.ndarray, ...]:
                c, o, *values = (np.concatenate(x) for x in zip(*sums, strict=True))
                order = np.lexsort((o, c))
                return added(*(x[order] for x in (c, o, *values)))

            for head, got in self.each(batches):
                if head is not None:
                    yield head
                    continue
                chunk_of, owner, flags, ctx, w, told = got
                sums.append(added(chunk_of, owner.astype(np.int64), *score(ctx, w, flags == 1, told)))
                if len(sums) == 4:
                    sums = [merged()]
            if sums:
                c, o, *values = merged()
                at = np.flatnonzero(np.concatenate((np.ones(min(1, len(c)), bool), c[1:] != c[:-1])))
                ends = np.append(at[1:], len(c))
                for lo in range(0, len(at), 500):
                    out = []
                    for i, j in zip(at[lo : lo + 500], ends[lo : lo + 500], strict=True):
                        out.append((int(c[i]) % self.parts, 0, int(c[i]), int(j - i), pack(o[i:j].astype(np.uint32), *(v[i:j].astype(k) for v, k in zip(values, kinds, strict=True))), None, None, None, None))
                    yield self.table(out)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, head, got = -1, None, []

            def out() -> Iterator[pa.RecordBatch]:
                ids, flags, sizes, extra = head
                sums = [np.zeros(len(ids)) for _ in kinds]
                for n, blob in got:
                    o, *values = unpack(blob, n, [np.uint32, *kinds])
                    for x, v in zip(sums, values, strict=True):
                        x[o] += v
                place = [pa.array(np.full(len(ids), now)), pa.array(np.arange(len(ids)))]
                cols = [*place, pa.array(ids, self.id_type), pa.array([x == 1 for x in flags]), pa.array(sizes, pa.int64()), pa.array(extra, pa.string()), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(cols, names)

            for b in batches:
                for _, bucket, of, n, blob, ids, flags, sizes, extra in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if of != now and head:
                        yield from out()
                        got = []
                    now = of
                    if bucket < 0:
                        head = ids, flags, sizes, extra
                    else:
                        got.append((n, blob))
            if head:
                yield from out()

        names = ["chunk", "place", "doc_id", "learn", "n_tokens", "extra", *(f"v{i}" for i in range(len(kinds)))]
        types = ["long", "long", self.kind, "boolean", "long", "string", *["double"] * len(kinds)]
        done = None
        for dealt in self.buckets_of(rows, counts, waves):
            part = dealt.mapInArrow(run, self.schema).repartitionById(self.parts, F.col("part")).sortWithinPartitions("chunk", "bucket")
            part = part.mapInArrow(add_up, ", ".join(map(" ".join, zip(names, types, strict=True))))
            part = stage(part, "wave") if waves > 1 else part
            done = part if done is None else done.unionByName(part)
        if waves > 1:
            done = done.groupBy("chunk", "place").agg(*(F.any_value(x).alias(x) for x in names[2:6]), *(F.sum(x).alias(x) for x in names[6:]))
        return done.select(*names[2:])


def _by_first(columns: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    whole = [np.concatenate(x) for x in zip(*columns, strict=True)]
    order = np.argsort(whole[0])
    return tuple(x[order] for x in whole)


def most(counted: DataFrame, n: int) -> int:
    """The least count of the rows of the largest counts (c), as many whole counts as have ``n`` rows at most."""
    levels = counted.groupBy("c").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("c")).limit(n).toArrow()
    fit = np.cumsum(levels["k"].to_numpy()) <= n
    return int(levels["c"].to_numpy()[fit].min(initial=1 << 62))


def _counted(a: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    order, first = _runs(pair_keys(a, w))
    a, w, c = a[order[first]], w[order[first]], np.diff(np.append(first, len(a)))
    order = np.lexsort((w, a))
    return pa.RecordBatch.from_arrays([pa.array(x[order].view(np.int64)) for x in (a, w, c)], ["a", "w", "c"])


class Vocabulary:
    """The words of ``words`` (w, c): how many, and the ``n_top`` most frequent ones by whole counts, at hand."""

    def __init__(self, words: DataFrame, n_top: int):
        total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.types = int(total["n"]), int(total["v"])
        least = most(words, n_top)
        top = words.filter(F.col("c") >= least).toArrow()
        order = np.lexsort((top["w"].to_numpy(), -top["c"].to_numpy()))
        self.ranked, self.often = top["w"].to_numpy()[order].astype(np.int64).view(np.uint64), top["c"].to_numpy()[order]
        #: the counts of all others, as buckets ask for them
        self.others = words.filter(F.col("c") < least).groupBy(F.lit(-1).cast("long").alias("a"), F.col("w").bitwiseOR(F.lit(-(1 << 63)).cast("long")).alias("w")).agg(F.sum("c").alias("c"))

    def hot(self, share: float, ends: int) -> dict[int, int]:
        """The words of more than ``share`` of all tokens and the start, which stands before as many tokens as there are ends."""
        size = {i: int(c) for i, c in enumerate(self.often[: int((self.often > self.n * share).sum())])} | ({int(_HIGH): ends} if ends > self.n * share else {})
        size.pop(int(np.flatnonzero(self.ranked == _END)[0]) if (self.ranked == _END).any() else -1, None)
        return size


def grow(ctx: list[np.ndarray], w: np.ndarray, learn: np.ndarray, p: np.ndarray, min_count: int, min_divergence: float, done: np.ndarray | None = None, first: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of the tokens ``w`` after their longest kept contexts.

    ``done`` marks the tokens for which ``p`` has the context of one word already; ``first`` numbers the words of ``ctx[0]``,
    where they are numbered already.

    ``ctx`` has the words before each token, nearest first; ``learn`` marks the tokens to learn from and ``p`` starts
    as the root's probabilities. Level by level a context that was met ``min_count`` times is kept if its next
    tokens diverge from what its longest kept suffix foretells, by ``min_divergence`` nats in all; it then mixes its
    counts with that suffix (Witten-Bell). A context met less often, or always followed by one token, has no longer
    one that could differ.
    """
    p = p.copy()
    live = np.arange(len(w))
    group = np.zeros(len(w), np.int64) if first is None else first
    for level, c in enumerate(ctx):
        if not len(live):
            break
        if level or first is None:
            group, _ = _dense(mix(group.astype(np.uint64) * _SALT + c[live]))
        key, one = _dense(mix(group.astype(np.uint64) * _LAST + w[live]))
        met = np.bincount(key, learn[live], len(one))
        seen = np.flatnonzero(met)
        of, count = group[one[seen]], met[seen]
        size = int(group.max()) + 1
        n, kinds = np.bincount(of, count, size), np.bincount(of, minlength=size)
        q = p[live[one[seen]]]
        gain = np.bincount(of, count * np.log(count / (n[of] * q)), size)
        keep = (n >= min_count) & (gain >= min_divergence)
        stays = (n >= min_count) & (kinds > 1)
        if done is not None:  # of the first level only, where all tokens live
            keep[group[done]] = False
            stays[group[done]] = True
            done = None
        mine = keep[group]
        g, at = group[mine], live[mine]
        p[at] = (met[key[mine]] + kinds[g] * p[at]) / (n[g] + kinds[g])
        stay = stays[group]
        live, group = live[stay], group[stay]
    return p


def suffix_tree(
    docs: DataFrame, key: str = "doc_id", text: str = "text", mod: int = 7, rest: int = 2, max_depth: int = 3, min_count: int = 2, min_divergence: float = 10.0, n_top: int = 1 << 18, chunk: int = 8_000_000,
    hot_share: float = 1 / 1024, waves: int = 2,
) -> DataFrame:
    """Probabilistic suffix tree: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    It learns from the rows whose crc32(key) mod ``mod`` isn't ``rest``, null keys among them. Contexts of up to
    ``max_depth`` words are kept by ``grow``; the root is add-one over all words. Null texts are empty (one end).
    Repeated rows are learned and scored one by one, an empty table gives no rows, extra columns are ignored, a string
    key stays a string. A very long text is a chunk of its own.

    The tokens after one word are held by one task. A word of more than ``hot_share`` of all tokens, and the start if
    it is one, are always kept as contexts and are dealt by the word before them too; what follows them is known from
    their pairs that were met ``min_count`` times, mixed with the root. The share is a number of the model, not of the
    cluster: scores don't depend on partitions, chunks or how rows are dealt. Nor on ``n_top``: that many words, and
    four times as many pairs, are sent to all tasks, and the counts of the others to those that meet them. Buckets pass
    in ``waves`` for the disk.
    """
    spark = docs.sparkSession
    held = _crc_rest("doc_id", mod) != rest
    rows = _texts(docs, key, text).select("doc_id", "text", held.alias("learn"), F.lit(None).cast("string").alias("extra"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, ts in _chunks([b], chunk // 2):
                w, c = np.unique(tokens(ts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["w", "c"])

    words = stage(rows.filter("learn").mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "tree-words")
    v = Vocabulary(words, n_top)
    ends = int(words.filter(F.col("w") == int(_END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    hot_size = v.hot(hot_share, ends)
    hot_words = np.array(sorted(hot_size), np.uint64)
    sent = spark.sparkContext.broadcast(Root(v.often, v.n, v.types))
    counts, at_hand = v.others, np.zeros(0, np.uint64)
    if hot_size:
        met = rows.filter("learn").mapInArrow(Deal(rows, max_depth, chunk, v.ranked, hot_words, at_hand).pairs, "a long, w long, c long").groupBy("a", "w").agg(F.sum("c").alias("c"))
        met = stage(met.filter(F.col("c") >= min_count), "tree-pairs")
        often = most(met, 4 * n_top)
        got = met.filter(F.col("c") >= often).toArrow()
        first, second = (got[x].to_numpy().astype(np.int64).view(np.uint64) for x in ("a", "w"))
        paired = {int(r["a"]) & ((1 << 64) - 1): int(r["c"]) for r in met.groupBy("a").agg(F.sum("c").alias("c")).collect()}
        sent_hot = spark.sparkContext.broadcast(Hot(hot_size, paired, first, second, got["c"].to_numpy()))
        counts, at_hand = counts.unionByName(met.filter(F.col("c") < often)), pair_keys(first, second)

    def score(ctx: list[np.ndarray], w: np.ndarray, taught: np.ndarray, told: Told) -> tuple[np.ndarray, ...]:
        p = sent.value.probability(w, told)
        hot = sent_hot.value.among(ctx[0]) if hot_size else np.zeros(len(w), bool)
        if hot.any():
            p[hot] = sent_hot.value.apply(ctx[0][hot], w[hot], p[hot], told)
        c1, _ = _dense(ctx[0])
        p = grow(ctx, w, taught, p, min_count, min_divergence, hot, c1)
        # every word but the start stands once before a token: its count is that of the tokens learned after it
        met = np.bincount(c1, taught)[c1]
        if hot.any():
            met[hot] = sent_hot.value.size[np.searchsorted(sent_hot.value.words, ctx[0][hot])]
        word = ctx[0] != _HIGH
        return np.where(word, np.log10(met + 1.0), 0.0), np.log10(p), (word & (met > 0)).astype(np.int64)

    done = stage(Deal(rows, max_depth, chunk, v.ranked, hot_words, at_hand).summed(rows, counts, score, [np.float64, np.float64, np.uint32], waves), "tree-scored")
    log_all = F.lit(float(np.log10(v.n + v.types + 1)))
    return done.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", (F.col("v2").cast("long") + int(ends > 0)).alias("n_known"), F.lit(v.n).cast("long").alias("train_tokens"),
        (F.col("v0") + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * log_all).alias("base_score"), F.col("v1").alias("score"),
    )
