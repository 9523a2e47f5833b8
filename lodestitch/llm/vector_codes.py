"""Short codes of integer vectors by product quantisation, with nearest entries found through a VA-file."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Bits of a cell: coordinates of entries fall into 2**BITS cells per dimension.
BITS = 4
#: Vector parts that are looked up at once; bounds of a block take ``BLOCK * ENTRIES * 8`` bytes.
BLOCK = 1024
#: Share by which bounds are widened, well over the rounding of sums of single floats.
MARGIN = 1e-5
#: Components beyond this would overflow the squares' sums.
LARGEST = 1 << 26


class VAFile:
    """The entries of one codebook (integers, at most 256) with their approximations.

    In each dimension the entries' coordinates are cut at quantiles into cells, which keep the least and largest
    coordinate they hold. For a query, a table of its squared distances to the near and far side of each cell gives
    bounds of its distance to every entry.
    """

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        self.entries = entries
        n, dims = entries.shape
        cells = 1 << bits
        rank = np.empty((n, dims), np.int64)
        for d in range(dims):
            values, place = np.unique(entries[:, d], return_inverse=True)
            rank[:, d] = place * cells // len(values)
        self.low, self.high = np.zeros((dims, cells), np.int32), np.zeros((dims, cells), np.int32)
        hot = np.zeros((dims, cells, n), np.float32)
        for d in range(dims):
            for c in np.unique(rank[:, d]):
                inside = rank[:, d] == c
                self.low[d, c], self.high[d, c] = entries[inside, d].min(), entries[inside, d].max()
                hot[d, c, inside] = 1
        self.hot = hot.reshape(dims * cells, n)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, queries by entries.

        Gaps are integers; squares and their sums, none of them negative, are single floats, so the lower bounds are
        taken down and the upper ones up by more than their relative rounding.
        """
        q = queries.astype(np.int32)[:, :, None]
        below, above = self.low[None] - q, q - self.high[None]
        flat = (len(queries), -1)
        near = np.maximum(np.maximum(below, above), 0).astype(np.float32).reshape(flat)
        far = np.maximum(-below, -above).astype(np.float32).reshape(flat)
        return (near * near) @ self.hot * np.float32(1 - MARGIN), (far * far) @ self.hot * np.float32(1 + MARGIN)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of each query's nearest entry, ties to the lower one; its squared distance; the distances computed."""
        index, error, refined = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), 0
        if not queries.shape[1]:
            return index, error, refined
        for at in range(0, len(queries), BLOCK):
            q = queries[at : at + BLOCK]
            lower, upper = self.bounds(q)
            row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
            gap = q[row] - self.entries[entry]
            distance = np.einsum("ij,ij->i", gap, gap)
            refined += len(row)
            # Rows come in order, entries ascend within one: the first least distance is the answer.
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            least = np.minimum.reduceat(distance, starts)
            hits = np.flatnonzero(distance == np.repeat(least, np.diff(np.r_[starts, len(row)])))
            first = hits[np.r_[True, row[hits][1:] != row[hits][:-1]]]
            index[at : at + BLOCK], error[at : at + BLOCK] = entry[first], least
        return index, error, refined


def integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are kept, which of those have ``width`` components, and these as floor(1024 x), padded to PARTS."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.values.slice(column.offsets[0].as_py(), int(size.sum())) if len(column) else column.values
    bad = ~np.isfinite(flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
    start = np.r_[0, np.cumsum(size)]
    wrong = np.r_[0, np.cumsum(bad)]
    keep = ~column.is_null().to_numpy(zero_copy_only=False) & (wrong[start[1:]] == wrong[start[:-1]])
    fit = keep & (size == width)
    x = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)[np.repeat(fit, size)].reshape(-1, width) if width else np.zeros((int(fit.sum()), 0))
    x = np.floor(1024 * x)
    if x.size and np.abs(x).max() > LARGEST:
        raise ArithmeticError(f"a component lies beyond {LARGEST // 1024}: its squares don't fit into longs")
    return keep, fit, np.pad(x.astype(np.int64), ((0, 0), (0, -width % PARTS)))


def _each_block(batch: pa.RecordBatch, column: int, width: int, books: list[VAFile]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    keep, fit, x = integers(batch.column(column), width)
    parts = np.split(x, PARTS, axis=1)
    return keep, fit, x, [b.nearest(p)[:2] for b, p in zip(books, parts, strict=True)]


def _books(entries: np.ndarray) -> list[VAFile]:
    return [VAFile(entries[p]) for p in range(PARTS)]


def first_entries(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """The components a vector has, and the parts of the 256 kept vectors with the smallest ids (PARTS, entries, width / PARTS)."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.filter(v.isNotNull() & finite)
    most = kept.groupBy(F.size(v).alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width = most["width"] if most else 0
    first = kept.filter((F.size(v) == width) & F.col("vec_id").isNotNull()).orderBy("vec_id", "vector").select("vector").limit(ENTRIES).toArrow()
    x = integers(first.column(0), width)[2] if first.num_rows else np.zeros((0, width + -width % PARTS), np.int64)
    if most and not len(x):  # no ids at all
        x = np.zeros((1, x.shape[1]), np.int64)
    return width, np.stack(np.split(x, PARTS, axis=1))


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[int, np.ndarray]:
    """The width and the codebooks after ``rounds``: each takes every part's nearest entry and moves entries to the floor of their mean.

    Tasks hand on one sum and count per entry they met; the driver holds the codebooks alone, PARTS * ENTRIES rows.
    """
    width, entries = first_entries(vectors)
    data = vectors.select("vector")

    def sums(entries: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = _books(entries)
            total, count = np.zeros(entries.shape, np.int64), np.zeros(entries.shape[:2], np.int64)
            for b in batches:
                _, _, x, found = _each_block(b, 0, width, books)
                for p, (index, _) in enumerate(found):
                    np.add.at(total[p], index, x[:, p * entries.shape[2] : (p + 1) * entries.shape[2]])
                    count[p] += np.bincount(index, minlength=entries.shape[1])
            part, entry = np.nonzero(count)
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

        return run

    for _ in range(rounds if entries.shape[1] else 0):
        partial = data.mapInArrow(sums(entries), "part int, entry int, n long, total array<long>")
        each = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(entries.shape[2])])
        entries = entries.copy()
        for row in each.collect():
            entries[row["part"], row["entry"]] = [row[f"t{k}"] // row["n"] for k in range(entries.shape[2])]
    return width, entries


def digest(entries: np.ndarray) -> str:
    """SHA-256 of the decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, width: int, entries: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of all kept rows, by the codebooks ``entries``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(entries)
        for b in batches:
            keep, fit, _, found = _each_block(b, 2, width, books)
            code, error = np.full(len(keep), None, object), np.full(len(keep), None, object)
            code[fit] = [bytes(x).hex() for x in np.stack([i for i, _ in found], axis=1).astype(np.uint8)]
            error[fit] = np.sum([e for _, e in found], axis=0, dtype=np.int64).tolist()
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask), pa.array(code[keep], pa.string()), pa.array(error[keep], pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return vectors.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def compress(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all rows whose vector is complete and finite.

    Codebooks are trained over all rows, then every row gets its nearest entries: a VA-file excludes entries by bounds
    and the rest are compared by integer distances, so results are exact. Fewer than 256 ids give fewer entries. Of
    repeated ids each row may start an entry, in order of id and vector; null ids start none but are encoded. Vectors
    are as long as most are (of equally many, the longer); others get a null code and error and move no entry.
    Lengths no multiple of four are filled with zeros. Null labels are one label. Components beyond 65,536 are an
    error, since their squares overflow. An empty table gives no rows. Other columns are not read.
    """
    rows = embeddings.select("vec_id", "label", F.col(vector).cast("array<double>").alias("vector"))
    width, entries = train(rows)
    coded = stage(encode(rows, width, entries), "vector-codes")
    by_label = small_side(stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors"))
    out = coded.join(by_label.withColumnRenamed("label", "l"), F.col("label").eqNullSafe(F.col("l")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))
