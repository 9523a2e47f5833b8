"""Packing token sequences by first-fit decreasing over a tournament tree.

Documents are dealt to partitions by a hash of their id and text, so the rows of a partition are a random
group of the corpus; a task packs its rows in groups of a bounded number of tokens. Inside a group every
document longer than a sequence first gives whole sequences, what is left is packed by first-fit decreasing
(the tree over bin capacities finds the first bin with room in log time), and the emptiest bins are then
cut up to fill the gaps of the others, so that at most one bin of a group is short. That last bin is cut at
powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that a task holds at once, and words whose ids a Python worker keeps.
GROUP_TOKENS, CACHE_WORDS = 4_000_000, 1_200_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length int"


class Tournament:
    """Bins of one capacity; ``place(size)`` puts an item into the first bin that has room for it."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)
        self.used = 0

    def place(self, size: int) -> int:
        best, i = self.best, 1
        while i < self.leaves:
            i *= 2
            if best[i] < size:
                i += 1
        best[i] -= size
        at, j = i - self.leaves, i >> 1
        while j:
            top = best[2 * j] if best[2 * j] >= best[2 * j + 1] else best[2 * j + 1]
            if best[j] == top:
                break
            best[j] = top
            j >>= 1
        self.used = max(self.used, at + 1)
        return at


def plan(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) pieces: each position of each item in exactly one piece.

    Every sequence is full, except that the last ones may be as long as a power of two.
    """
    out: list[list[tuple[int, int, int]]] = []
    rest = []
    for k, n in enumerate(sizes):
        whole = n - n % capacity
        out += [[(k, at, capacity)] for at in range(0, whole, capacity)]
        if n > whole:
            rest.append((n - whole, k, whole))
    if not rest:
        return out
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree = Tournament(len(rest), capacity)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in rest]
    for n, k, at in rest:
        bins[tree.place(n)].append((k, at, n))
    left = sorted(((sum(x[2] for x in b), b) for b in bins[: tree.used]), key=lambda x: -x[0])
    lo, hi = 0, len(left) - 1
    spare: list[tuple[int, int, int]] = []
    have = 0
    while lo <= hi:
        need = capacity - left[lo][0]
        while have < need and lo < hi:
            spare += left[hi][1]
            have += left[hi][0]
            hi -= 1
        if have < need:
            break
        full = left[lo][1]
        while need:
            k, at, n = spare.pop()
            take = min(n, need)
            full.append((k, at, take))
            if take < n:
                spare.append((k, at + take, n - take))
            need -= take
            have -= take
        out.append(full)
        lo += 1
    spare += [x for _, b in left[lo : hi + 1] for x in b]
    total = sum(x[2] for x in spare)
    bit = 1
    while bit * 2 <= capacity:
        bit *= 2
    while total:
        size = capacity if total >= capacity else bit
        if size > total:
            bit //= 2
            continue
        total -= size
        one = []
        while size:
            k, at, n = spare.pop()
            take = min(n, size)
            one.append((k, at, take))
            if take < n:
                spare.append((k, at + take, n - take))
            size -= take
        out.append(one)
    return out


# The split pattern and the settings of tokenizers whose texts may be cut at blanks.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": _PARTS}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def cuts_at_blanks(settings: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space and splits as the fast path does; judged by its own file."""
    return settings.get("normalizer") == _NORMALIZER and settings.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]} and settings["model"]["type"] == "BPE"


class Words:
    """Token ids of whole texts by any tokenizers file.

    Where the file's settings say that white space is dropped before the split (``cuts_at_blanks``), the ids of a
    text are those of its chunks between blanks in turn, which are kept for reuse: chunks of ASCII and Latin letters,
    digits and marks are split here and go straight to the merge model, any other chunk goes through the whole
    tokenizer. With other settings every text goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            self.fast = cuts_at_blanks(json.load(f))
        self.plain = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
        self.parts = regex.compile(_PARTS).findall
        self.special = tuple(x.content for x in self.whole.get_added_tokens_decoder().values())
        # byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.bytes = {b: b if b in keep else next(rest) for b in range(256)}
        self.kept: dict[str, np.ndarray] = {}

    def chunk(self, c: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if self.plain.fullmatch(c) and not any(s in c for s in self.special):
            ids = []
            for p in self.parts(c.lower()):
                if not p.isascii():
                    p = p.encode().decode("latin-1").translate(self.bytes)
                ids += [x.id for x in self.model.tokenize(p)]
        else:
            ids = self.whole.encode(c, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        if not self.fast:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        kept, out = self.kept, []
        for c in text.replace("\n", " ").split(" "):
            ids = kept.get(c)
            if ids is None:
                ids = self.chunk(c)
                if len(kept) < CACHE_WORDS:
                    kept[c] = ids
            out.append(ids)
        return b"".join(out)


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    """One per Python worker: its cache serves all tasks of the worker."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack every document into sequences of ``capacity`` tokens; one row per piece.

    ``tokenizer`` is the path of a tokenizers file, the same on all machines. A document is its ids and then
    ``end_id``; a null or empty text is ``end_id`` alone. Repeated rows are packed one by one; a null key stays
    null, a string key stays a string. An empty table gives no rows. Extra columns are ignored. ``with_ids`` adds the
    ids of each piece.
    """
    spark = docs.sparkSession
    text_key = dict(docs.dtypes)[key] == "string"
    key_type, schema = (pa.string(), SCHEMA.replace("doc_id long", "doc_id string")) if text_key else (pa.int64(), SCHEMA)
    cols = docs.select((F.col(key) if text_key else F.col(key).cast("long")).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = cols.withColumn("h", F.xxhash64("doc_id", "text"))
    dealt = cols.repartition(n, "h").sortWithinPartitions("h", "doc_id").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = words(tokenizer), np.array([end_id], "<u4").tobytes()
        seq = TaskContext.get().partitionId() << 36
        keys: list[int | str | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            lengths = [len(x) // 4 for x in held]
            rows = []
            blobs = []
            for s in plan(lengths, capacity):
                off, total = 0, sum(x[2] for x in s)
                for k, at, take in s:
                    piece = held[k][4 * at : 4 * (at + take)]
                    rows.append((keys[k], at, take, zlib.crc32(piece), lengths[k], seq, off, total))
                    if with_ids:
                        blobs.append(piece)
                    off += take
                seq += 1
            for at in range(0, len(rows), 50_000):
                part = list(zip(*rows[at : at + 50_000], strict=True))
                arrays = [pa.array(part[0], key_type), *(pa.array(c, pa.int64()) for c in part[1:7]), pa.array(part[7], pa.int32())]
                names = SCHEMA_NAMES
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<i4") for x in blobs[at : at + 50_000]], pa.list_(pa.int32())))
                    names = [*SCHEMA_NAMES, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.text(t) + end
                keys.append(d)
                held.append(ids)
                size += len(ids) // 4
                if size >= GROUP_TOKENS:
                    yield from flush()
                    keys, held, size = [], [], 0
        if held:
            yield from flush()

    return dealt.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
