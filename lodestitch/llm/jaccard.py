"""N-gram Jaccard join by vertical partitioning.

The hashes of the shingles are the global n-gram order, cut into fragments. Two sets of Jaccard ``t`` or more
differ in at most ``d = (1 - t) / (1 + t) * (|A| + |B|)`` n-grams, so of ``d + m`` fragments at least ``m`` hold equal
segments (pigeonhole): a document is keyed by the segments of its fragments. Keys are cut per band of sizes
(ratio ``1 / t``); a document gives those of its own band and of the one below, so each possible pair meets.
Documents with fewer than ``m`` empty fragments leave the empty ones out: such a pair still shares a segment.

Keys are dealt by ranges of their hash straight from the texts, packed into one binary row per chunk and range
(sorted keys byte by byte, classes as numbers in the row's list), so a shuffle moves about 8 bytes a key and no
row is made for a key that one class alone has. A key that many classes of one chunk share sends one of them; the
others leave the chunk as rows of their own.

Candidate pairs are verified exactly: overlaps are counted fragment by fragment and summed per pair. Before that,
each set is a row of bits, the parities of its n-grams in as many bins as it has n-grams or more: two sets differ
in at least as many n-grams as their bits do, so pairs whose bits differ too much are left out without loss. Equal
sets are one class from the start. First a key links its members to two of them only: the one that meets most
others over all its keys (in a group of near copies the one that most were made from), and one by hash. Classes
that share a key and still lie in different components are tested in a second round: their n-grams are ordered
by how many of these classes hold them, rarest first, and a pair must share an n-gram of both prefixes at places
that leave room for the overlap. A copy with many changes has a prefix of its own and meets nothing. So no link
between components is lost, and a large group of near copies costs about as many pairs as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, small_side, stage

_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What each byte adds at the first places of a word.
_PLACED = mix(_BYTE + np.arange(64, dtype=np.uint64)[:, None] * _BASE)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in turn, and the number of words of each text."""
    raw = np.frombuffer(b" ".join([*texts, b""]).translate(_LOW), np.uint8)
    gap = _BLANK.take(raw)
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    first, last = edge[::2], edge[1::2]
    # the bytes of each word, weighed by their place and summed
    place = np.arange(len(raw))
    if len(first):
        place[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(raw))))
    far = np.flatnonzero((place >= len(_PLACED)) & ~gap) if (last - first).max(initial=0) > len(_PLACED) else first[:0]
    values = _PLACED.ravel().take(np.minimum(place, len(_PLACED) - 1) << 8 | raw)
    values[far] = mix(_BYTE[raw[far]] + place[far].astype(np.uint64) * _BASE)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    words = mix(sums[last] - sums[first] + (last - first).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.concatenate(([0], np.searchsorted(first, ends))))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    for n in counts.tolist():
        w = words[at : at + n]
        at += n
        width = min(k, n)
        if not n:
            out.append(w)
            continue
        h = np.full(n - width + 1, width, np.uint64)
        for j in range(width):
            h = mix(h * _BASE + w[j : j + n - width + 1])
        out.append(np.unique(h))
    return out


def class_of(s: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(s + _BASE * np.full(1, len(s), np.uint64))).view(np.int64)) if len(s) else 0


def bands(num: int, den: int, most: int = 1 << 31) -> list[int]:
    """Upper sizes of the bands: each band's sizes reach over 1/t to the next band only."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * den // num))
    return out


def segment_keys(s: np.ndarray, num: int, den: int, uppers: list[int]) -> np.ndarray:
    """Keys of the fragments of the set ``s`` in its own band and in the band below."""
    own = int(np.searchsorted(uppers, len(s)))
    found = []
    for band in {own, max(0, own - 1)}:
        hi = uppers[band]
        d = (den - num) * (hi + hi * den // num) // (den + num)
        margin = 1 if d == 0 else 2 + d // 12
        cuts = d + margin
        frag = ((s >> np.uint64(32)) * np.uint64(cuts)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1])))
        folded = np.bitwise_xor.reduceat(mix(s + _BASE), starts)
        tag = np.uint64((band + 1) << 40)
        found.append(mix(folded + mix(frag[starts] + tag)))
        empty = cuts - len(starts)
        if empty >= margin:
            gone = np.setdiff1d(np.arange(cuts, dtype=np.uint64), frag[starts], assume_unique=True)
            found.append(mix(mix(gone + tag)))
    return np.concatenate(found).view(np.int64)


def parities(s: np.ndarray) -> np.ndarray:
    """Words of 64 bits: whether a bin holds an odd number of the n-grams, for the least power of two bins that is no less than 64 or the set."""
    bins = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bins - 1)).view(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id as it is (a long unless it is a string) and the text's bytes, empty for null."""
    own = F.col(key) if dict(docs.dtypes)[key] == "string" else F.col(key).cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))


def _kind(df: DataFrame, name: str = "doc_id") -> str:
    return df.schema[name].dataType.simpleString()


def _slices(batches: Iterator[pa.RecordBatch], size: int = 1_000_000, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each with about ``size`` bytes in a binary ``column``, or one longer row."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, to - at)
            at = to


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 1_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts, about ``size`` bytes at a time."""
    for b in _slices(batches, size):
        yield b.column(0).to_pylist(), b.column(1).to_pylist()


def components(pairs: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """id and label (the smallest id reachable) of every id in ``pairs``: large star, small star, until nothing changes."""
    edges = stage(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        new = stage(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        now = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop_staged(edges)
        edges = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def segments(docs: DataFrame, ids: DataFrame, k: int, key: str, text: str, fragments: int = 8) -> DataFrame:
    """cid, fragment, n and grams: the sets of the rows ``ids``, cut by ranges of the n-gram order; fragment -1 holds the parities."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _chunks(batches, 250_000):
            rows = []
            for s in shingle_sets(texts, k):
                at = np.searchsorted(s >> np.uint64(32), (np.arange(fragments + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(fragments))
                c = class_of(s)
                rows += [(c, f, len(s), s[i:j].view(np.int64)) for f, (i, j) in enumerate(zip(at, at[1:], strict=False)) if j > i]
                if len(s):
                    rows.append((c, -1, len(s), parities(s)))
            if rows:
                c, f, n, g = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(f, pa.int32()), pa.array(n, pa.int64()), pa.array(g, pa.list_(pa.int64()))], ["cid", "fragment", "n", "grams"])

    chosen = _texts(docs, key, text).join(ids, "doc_id", "left_semi")
    return chosen.mapInArrow(cut, "cid long, fragment int, n long, grams array<long>").dropDuplicates(["cid", "fragment"])


def close(cut: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs`` (a, b: classes) that sizes and parities leave possible."""
    bits = cut.filter("fragment = -1")
    both = bits.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("x")).join(small_side(pairs), "a")
    both = both.join(bits.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("y")), "b")
    both = both.filter(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))

    def folded(x: str, y: str) -> Column:
        """``x`` with half as many bins, where it has twice as many as ``y``."""
        half = F.size(y)
        lower, upper = F.slice(x, F.lit(1), half), F.slice(x, half + 1, half)
        return F.when(F.size(x) == 2 * half, F.zip_with(lower, upper, lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    both = both.select("a", "b", "n_a", "n_b", folded("x", "y").alias("x"), folded("y", "x").alias("y"))
    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    unlike = (F.size("x") == F.size("y")) & ((num + den) * differ > (den - num) * (F.col("n_a") + F.col("n_b")))
    return both.filter(~unlike).select("a", "b")


def overlaps(cut: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs`` (a, b: classes) that pass the threshold; partial overlaps are counted by fragment and summed."""
    pairs = stage(close(cut, pairs, num, den), "jaccard-close")
    if pairs.isEmpty():
        return pairs
    cut = cut.filter("fragment >= 0")
    left = cut.select(F.col("cid").alias("a"), "fragment", F.col("n").alias("n_a"), F.col("grams").alias("g_a"))
    right = cut.select(F.col("cid").alias("b"), "fragment", F.col("n").alias("n_b"), F.col("grams").alias("g_b"))
    few = small_side(pairs)
    if few is not pairs:
        right = right.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    partial = left.join(few, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("g_a", "g_b")).cast("long").alias("c"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("c").alias("c"))
    return summed.filter(den * F.col("c") >= num * (F.col("n_a") + F.col("n_b") - F.col("c"))).select("a", "b")


def _sorted(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((c, k))
    k, c = k[order], c[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    k, c = k[new], c[new]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    return k, c, first, np.diff(np.append(first, len(k)))


def _packed(k: np.ndarray, c: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted keys byte by byte, the highest bytes of which repeat, the distinct classes, and each key's place among them."""
    known, at = np.unique(c, return_inverse=True)
    return k.view(np.uint8).reshape(-1, 8).T.tobytes(), known.tobytes(), at.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32).tobytes()


def _unpacked(keys: bytes, known: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(keys) // 8
    k = np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, n).T).view(np.uint64).ravel()
    return k, np.frombuffer(known, np.int64)[np.frombuffer(at, np.uint16 if len(at) == 2 * n else np.uint32)]


def members(rows: DataFrame, k: int, num: int, den: int, hot: int = 64, size: int = 8_000_000) -> DataFrame:
    """doc_id, n and cid per row of ``rows`` (doc_id, text), and key and cid of the classes that share a key with another.

    Rows of the second kind have a key and may repeat. A key with over ``hot`` classes in a chunk of ``size`` bytes is
    dealt on with its first class only; all its classes there pass by as rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, uppers, kind = 4 * parts, bands(num, den), _kind(rows)
    plain = f"doc_id {kind}, n long, key long, cid long"
    own = pa.string() if kind == "string" else pa.int64()
    names = ["doc_id", "n", "key", "cid", "bucket", "keys", "known", "at"]

    def batch(n: int, /, **columns: pa.Array) -> pa.RecordBatch:
        types = [own, *[pa.int64()] * 3, pa.int32(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

    def passing(key: pa.Array | None, cid: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
        # in turn and not by class: copies are many
        spread = buckets + ((mix(cid[:1].view(np.uint64)) + np.arange(len(cid), dtype=np.uint64)) % np.uint64(parts)).astype(np.int32)
        return batch(len(cid), cid=pa.array(cid), bucket=pa.array(spread), **columns, **({} if key is None else {"key": key}))

    def dealt(found: list[np.ndarray], cids: list[int]) -> Iterator[pa.RecordBatch]:
        k, c, first, n = _sorted(np.concatenate(found).view(np.uint64), np.repeat(np.array(cids, np.int64), [len(x) for x in found]))
        if (n > hot).any():
            crowd = np.repeat(n > hot, n)
            yield passing(pa.array(k[crowd].view(np.int64)), c[crowd])
            crowd[first] = False
            k, c = k[~crowd], c[~crowd]
        b = ((k >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        rows = [_packed(k[i:j], c[i:j]) for i, j in zip(at, np.append(at[1:], len(k)), strict=True)]
        yield batch(len(at), bucket=pa.array(b[at].astype(np.int32)), **{x: pa.array(y, pa.binary()) for x, y in zip(names[5:], zip(*rows, strict=True), strict=True)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in a task give their keys once; forgetting some only repeats keys
        found: list[np.ndarray] = []
        held: list[int] = []
        for b in _slices(batches, 250_000):
            sets = shingle_sets(b.column(1).to_pylist(), k)
            cids = [class_of(s) for s in sets]
            yield passing(None, np.array(cids, np.int64), doc_id=b.column(0), n=pa.array([len(s) for s in sets], pa.int64()))
            for s, c, known in zip(sets, cids, pc.is_valid(b.column(0)).to_pylist(), strict=True):
                if len(s) and known and c not in seen:
                    found.append(segment_keys(s, num, den, uppers))
                    held.append(c)
                    seen.add(c)
            if 8 * sum(len(x) for x in found) >= size:
                yield from dealt(found, held)
                found, held = [], []
            if len(seen) > 500_000:
                seen.clear()
        if found:
            yield from dealt(found, held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ks, cs = None, [], []

        def shared() -> Iterator[pa.RecordBatch]:
            k, c, _, n = _sorted(np.concatenate(ks), np.concatenate(cs))
            keep = np.repeat(n > 1, n)
            if keep.any():
                yield batch(int(keep.sum()), key=pa.array(k[keep].view(np.int64)), cid=pa.array(c[keep])).select(names[:4])

        for b in batches:
            by = b.select(names[:4]).filter(pc.is_valid(b["cid"]))
            if by.num_rows:
                yield by
            b = b.filter(pc.is_valid(b["keys"]))
            for bucket, *row in zip(*(b[x].to_pylist() for x in names[4:]), strict=True):
                if bucket != now and ks:
                    yield from shared()
                    ks, cs = [], []
                now = bucket
                keys, classes = _unpacked(*row)
                ks.append(keys)
                cs.append(classes)
        if ks:
            yield from shared()

    packed = rows.mapInArrow(deal, f"{plain}, bucket int, keys binary, known binary, at binary")
    return packed.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(meet, plain)


def stars(met: DataFrame) -> DataFrame:
    """a and b: each class of ``met`` (key, cid) with the two leads of each of its keys."""
    n = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weight = met.join(n, "key").groupBy("cid").agg(F.sum("n").alias("w"))
    m = met.join(weight, "cid")
    lead = m.groupBy("key").agg(F.min(F.struct(-F.col("w"), "cid")).alias("x"), F.min(F.struct(F.xxhash64("cid"), "cid")).alias("y"))
    met_lead = met.join(lead.select("key", F.array("x.cid", "y.cid").alias("leads")), "key").select("cid", F.explode("leads").alias("c")).filter("cid != c")
    return met_lead.select(F.least("cid", "c").alias("a"), F.greatest("cid", "c").alias("b")).distinct()


def rarest(cut: DataFrame, num: int, den: int, hot: int = 64, size: int = 500_000) -> DataFrame:
    """cid, n, own and grams per set of ``cut``: the part of its prefix that other sets have too, rarest first.

    ``own`` n-grams stand before it that no other set has; sets whose prefix they fill have no row. N-grams are dealt
    by ranges of their hash, packed, counted there and dealt back by class. An n-gram with over ``hot`` classes in a
    chunk of ``size`` n-grams is counted as one of them with that weight; the others pass by, packed, and look it up in
    the sums of their range, which a join adds.
    """
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    # rows of n-grams have no range, those that pass by no weights, sums no classes
    names = ["bucket", "range", "keys", "known", "sizes", "at", "weights"]
    types = [*[pa.int32()] * 2, *[pa.binary()] * 5]
    plain = "bucket int, range int, keys binary, known binary, sizes binary, at binary, weights binary"

    def batch(n: int, /, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

    def by_gram(g: np.ndarray) -> np.ndarray:
        return (((g >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)

    def by_class(c: np.ndarray) -> np.ndarray:
        return (mix(c.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)

    def packed(bucket: np.ndarray, g: np.ndarray, c: np.ndarray, n: np.ndarray, w: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if not len(g):
            return
        order = np.lexsort((g, bucket))
        bucket, g, c, n = bucket[order], g[order], c[order], n[order]
        w = None if w is None else w[order]
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rows = []
        for i, j in zip(at, np.append(at[1:], len(g)), strict=True):
            keys, known, place = _packed(g[i:j], c[i:j])
            sizes = n[i:j][np.unique(c[i:j], return_index=True)[1]]
            rows.append((keys, known, sizes.tobytes(), place, None if w is None else w[i:j].tobytes()))
        columns = {x: pa.array(y, pa.binary()) for x, y in zip(names[2:], zip(*rows, strict=True), strict=True)}
        if w is None:
            spread = buckets + ((mix(c[:1].view(np.uint64)) + np.arange(len(at), dtype=np.uint64)) % np.uint64(parts)).astype(np.int32)
            yield batch(len(at), bucket=pa.array(spread), range=pa.array(bucket[at]), **columns)
        else:
            yield batch(len(at), bucket=pa.array(bucket[at]), **columns)

    def unpacked(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        keys, known, sizes, at, weights = row
        g, place = _unpacked(keys, np.arange(len(known) // 8).tobytes(), at)
        return g, np.frombuffer(known, np.int64)[place], np.frombuffer(sizes, np.int64)[place], None if weights is None else np.frombuffer(weights, np.int64)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray] | pa.RecordBatch]:
        """The n-grams, classes, sizes and weights of each bucket, and the rows that pass by as they come."""
        now, held = None, []
        for b in batches:
            by = b.filter(pc.is_null(b["weights"]))
            if by.num_rows:
                yield by
            b = b.filter(pc.is_valid(b["weights"]))
            for bucket, *row in zip(*(b[x].to_pylist() for x in ("bucket", *names[2:])), strict=True):
                if held and bucket != now:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                    held = []
                now = bucket
                held.append(unpacked(row))
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def dealt(g: np.ndarray, c: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(g, kind="stable")
        g, c, n = g[order], c[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        met = np.diff(np.append(first, len(g)))
        w = np.ones(len(g), np.int64)
        crowd = np.repeat(met > hot, met)
        if crowd.any():
            w[first[met > hot]] = met[met > hot]
            crowd[first] = False
            yield from packed(by_gram(g[crowd]), g[crowd], c[crowd], n[crowd], None)
        yield from packed(by_gram(g[~crowd]), g[~crowd], c[~crowd], n[~crowd], w[~crowd])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for b in batches:
            each = pc.list_value_length(b["grams"]).to_numpy(zero_copy_only=False)
            g = b["grams"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            held.append((g, np.repeat(b["cid"].to_numpy(), each), np.repeat(b["n"].to_numpy(), each)))
            total += len(g)
            if total >= size:
                yield from dealt(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, total = [], 0
        if total:
            yield from dealt(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def counted(g: np.ndarray, c: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(g, kind="stable")
        g, c, n, w = g[order], c[order], n[order], w[order]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        df, most = np.add.reduceat(w, first), np.maximum.reduceat(w, first)
        each = np.repeat(df, np.diff(np.append(first, len(g))))
        return [x[each > 1] for x in (g, c, n, each)], (g[first[most > 1]], df[most > 1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for bucket in grouped(batches):
            if isinstance(bucket, pa.RecordBatch):
                yield bucket
                continue
            rows, (g, df) = counted(*bucket)
            if len(g):
                yield batch(1, range=pa.array(by_gram(g[:1])), keys=pa.array([g.tobytes()]), weights=pa.array([df.tobytes()]))
            held.append(rows)
            total += len(rows[0])
            if total >= size:
                g, c, n, w = (np.concatenate(x) for x in zip(*held, strict=True))
                yield from packed(by_class(c), g, c, n, w)
                held, total = [], 0
        if total:
            g, c, n, w = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from packed(by_class(c), g, c, n, w)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for b in batches:
            for *row, sums, weights in zip(*(b[x].to_pylist() for x in (*names[2:6], "sum_keys", "sums")), strict=True):
                g, c, n, _ = unpacked((*row, None))
                held.append((g, c, n, np.frombuffer(weights, np.int64)[np.searchsorted(np.frombuffer(sums, np.uint64), g)]))
                total += len(g)
                if total >= size:
                    g, c, n, w = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield from packed(by_class(c), g, c, n, w)
                    held, total = [], 0
        if total:
            g, c, n, w = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from packed(by_class(c), g, c, n, w)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, c, n, w in grouped(batches):
            order = np.lexsort((g, w, c))
            g, c, n = g[order], c[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            shared = np.diff(np.append(first, len(c)))
            own = n[first] - shared
            length = np.clip(n[first] + (-n[first] * num) // den + 1 - own, 0, shared)
            take = np.arange(len(c)) - np.repeat(first, shared) < np.repeat(length, shared)
            some = length > 0
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(length[some])))
            grams = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(g[take].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (c[first], n[first], own)] + [grams], ["cid", "n", "own", "grams"])

    sets = cut.select("cid", "n", "grams").mapInArrow(deal, plain)
    met = sets.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(count, plain)
    met = stage(met, "jaccard-counts")
    sums = met.filter("known IS NULL").select("range", F.col("keys").alias("sum_keys"), F.col("weights").alias("sums"))
    passed = met.filter("known IS NOT NULL AND range IS NOT NULL").join(sums, "range").select(*names[2:6], "sum_keys", "sums")
    rows = met.filter("range IS NULL").unionByName(passed.mapInArrow(back, plain))
    out = stage(rows.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(pick, "cid long, n long, own long, grams array<long>"), "jaccard-prefixes")
    drop_staged(met)
    return out


def prefixes(cut: DataFrame, open_: DataFrame, num: int, den: int) -> DataFrame:
    """a and b: the pairs of ``open_`` (cid, label) with different labels that the prefixes of their sets leave possible."""
    sets = cut.filter("fragment >= 0").join(small_side(open_.select("cid")), "cid", "left_semi")
    held = rarest(sets, num, den).join(small_side(open_), "cid")
    held = held.select("cid", "label", "n", "own", F.posexplode("grams").alias("i", "g"))
    left = held.select("cid", "label", "n", (F.col("own") + F.col("i")).alias("at"), "g")
    right = left.select("g", *(F.col(c).alias(f"{c}_2") for c in ("cid", "label", "n", "at")))
    room = 1 + F.least(F.col("n") - F.col("at"), F.col("n_2") - F.col("at_2")) - 1
    fits = (F.col("label") < F.col("label_2")) & ((num + den) * room >= num * (F.col("n") + F.col("n_2")))
    fits = fits & (den * F.least("n", "n_2") >= num * F.greatest("n", "n_2"))
    both = left.alias("l").join(right.alias("r"), (F.col("l.g") == F.col("r.g")) & fits)
    return both.select(F.least("cid", "cid_2").alias("a"), F.greatest("cid", "cid_2").alias("b")).distinct()


def join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id per row of ``docs``.

    Words are runs of non-blank characters, with A-Z lower-cased. Two rows link where ``den`` * intersection >=
    ``num`` * union of their shingle sets; null or blank texts have no set and link with nothing. Repeated rows stay
    rows; with a null key a row is its own component, null. A string key stays a string, any other is a long. An
    empty table gives no rows; extra columns are ignored. A text is held by one task, so memory grows with the longest.
    """
    every = stage(members(_texts(docs, key, text), k, num, den), "jaccard-keys")
    sized = every.filter("key IS NULL").select("doc_id", "n", "cid")
    reps = sized.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"))
    met = stage(every.filter("key IS NOT NULL").select("key", "cid").distinct(), "jaccard-members")
    # one row of each class that met another; rows without a key stand for no class of others
    ids = stage(sized.filter("doc_id IS NOT NULL").join(met.select("cid").distinct(), "cid", "left_semi").groupBy("cid").agg(F.min("doc_id").alias("doc_id")), "jaccard-ids")
    cut = stage(segments(docs, small_side(ids.select("doc_id")), k, key, text), "jaccard-segments")

    near = stage(stars(met), "jaccard-pairs")
    links = stage(overlaps(cut, near, num, den), "jaccard-links")
    drop_staged(near)
    labels = stage(components(links, "a", "b"), "jaccard-labels").withColumnRenamed("id", "cid")
    m = met.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = m.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key")
    open_ = stage(m.join(mixed, "key", "left_semi").select("cid", "label").distinct(), "jaccard-open")
    drop_staged(met)
    pairs = stage(prefixes(cut, open_, num, den), "jaccard-pairs")
    more = stage(overlaps(cut, pairs, num, den), "jaccard-links")
    if not more.isEmpty():
        labels = stage(components(links.unionByName(more), "a", "b"), "jaccard-labels").withColumnRenamed("id", "cid")
    drop_staged(cut, pairs)

    grouped = reps.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component"))
    classes = grouped.join(least, "label").select("cid", "component")
    both = sized.join(classes, "cid", "left")
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` but for those whose component has a smaller id; rows without a key or set stay."""
    found = join(docs, key=key, **options)
    gone = small_side(stage(found.filter("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct(), "jaccard-gone"))
    return docs.join(gone, docs[key] == gone["gone_id"], "left_anti")
