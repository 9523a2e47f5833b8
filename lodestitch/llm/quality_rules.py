"""Quality rules: distribution divergence from language references.

Each document gives two histograms, of character classes and of the common words of its language. References don't
come from the judged rows: they are the shipped profiles of a language, or the mean histograms of rows named as
trusted, damped per document so that long ones weigh no more than ``damp`` words. A document fails when a
Jensen-Shannon distance to its reference passes the limit; texts under the minimum lengths aren't judged by
divergence.

One Arrow pass counts; its rows are narrow (counts only), references are a grouped sum over the trusted ones, and the
verdict joins one reference row per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stage

#: Common function words by language code; other languages use all of them.
COMMON = {
    "en": "the of and to in a is that for it on was with as be by at this from or are an not have you".split(),
    "fr": "de la le et les des en un une du que qui est pour dans sur par au avec ce il pas plus ne elle".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
# Share of all words that each common word has in running text, in the order of COMMON; rounded.
COMMON_SHARE = {
    "en": (0.060, 0.030, 0.028, 0.026, 0.021, 0.022, 0.011, 0.011, 0.009, 0.010, 0.007, 0.009, 0.007, 0.007, 0.006, 0.005, 0.005, 0.005, 0.004, 0.004, 0.005, 0.003, 0.005, 0.004, 0.008),
    "fr": (0.045, 0.028, 0.027, 0.023, 0.020, 0.017, 0.015, 0.013, 0.011, 0.012, 0.012, 0.009, 0.011, 0.009, 0.009, 0.007, 0.007, 0.006, 0.005, 0.005, 0.008, 0.006, 0.005, 0.006, 0.004),
    "de": (0.030, 0.030, 0.027, 0.018, 0.011, 0.010, 0.012, 0.012, 0.009, 0.008, 0.007, 0.007, 0.007, 0.009, 0.008, 0.007, 0.008, 0.008, 0.007, 0.006, 0.006, 0.006, 0.005, 0.005),
    "es": (0.055, 0.037, 0.028, 0.028, 0.026, 0.026, 0.020, 0.015, 0.013, 0.012, 0.011, 0.011, 0.010, 0.010, 0.010, 0.009, 0.008, 0.007, 0.008, 0.006, 0.005, 0.005, 0.004, 0.004, 0.003),
}
# Share of the character classes in running text, in the order of CLASSES; rounded.
CLASS_SHARE = {
    "en": (0.775, 0.030, 0.010, 0.160, 0.025, 0.0, 0.0),
    "fr": (0.745, 0.025, 0.010, 0.160, 0.035, 0.0, 0.025),
    "de": (0.745, 0.060, 0.010, 0.140, 0.030, 0.0, 0.015),
    "es": (0.755, 0.025, 0.010, 0.165, 0.030, 0.0, 0.015),
}
CLASSES = ("lower", "upper", "digit", "blank", "point", "symbol", "other")
SYMBOLS = b"#*$%&|<>"

_kind = np.full(256, 6, np.uint8)
_kind[[*range(97, 123)]] = 0
_kind[[*range(65, 91)]] = 1
_kind[[*range(48, 58)]] = 2
_kind[[32, *range(9, 14)]] = 3
_kind[[*b".,;:!?'\"()-"]] = 4
_kind[[*b"#*$%&|<>@+=/\\^_`{}[]~"]] = 5
_kind[[*range(128, 192)]] = 255  # continuation bytes: no character of their own


def repeated(words: list[bytes], n: int = 3) -> int:
    """Words that lie in an ``n``-word window found twice or more, the first included."""
    total = len(words) - n + 1
    if total < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(n)), strict=False))
    seen: set = set()
    twice = set()
    for g in grams:
        if g in seen:
            twice.add(g)
        else:
            seen.add(g)
    if not twice:
        return 0
    out, upto = 0, 0
    for i, g in enumerate(grams):
        if g in twice:
            out += i + n - max(i, upto)
            upto = i + n
    return out


def measure(text: str, lang: str | None, common: dict[str, dict[bytes, int]], n_common: int) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = b"".join(words)
    dup, lines = 0, set()
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line in lines:
                dup += bool(line.split())
            else:
                lines.add(line)
    counts = np.bincount(_kind[np.frombuffer(raw, np.uint8)], minlength=256)
    bins = common.get(lang or "", common[""])
    hist = [0] * (n_common + 1)
    for w in words:
        hist[bins.get(w.lower(), n_common)] += 1
    chars = sum(1 for b in joined if b & 0xC0 != 0x80) if not joined.isascii() else len(joined)
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated(words), counts[: len(CLASSES)].tolist(), hist


def _js(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance in bits (0 to 1) of two arrays of shares; 0 log 0 counts as 0."""
    half = F.zip_with(
        p, q,
        lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0),
    )
    return F.sqrt(F.greatest(F.aggregate(half, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def _share(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(a, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def bins() -> dict[str, dict[bytes, int]]:
    """Numbers of the common words by language; all of them in turn, as far as there are bins, for other languages."""
    n = max(len(set(x)) for x in COMMON.values())
    every = list(dict.fromkeys(w for x in zip(*COMMON.values(), strict=False) for w in x))[:n]
    return {k: {w.encode(): i for i, w in enumerate(dict.fromkeys(v))} for k, v in COMMON.items()} | {"": {w.encode(): i for i, w in enumerate(every)}}


def shipped(lang: str | None) -> tuple[list[float], list[float]] | None:
    """The profile of a language: shares of the character classes, and of the common words with all others last."""
    if lang not in COMMON:
        return None
    q = list(COMMON_SHARE[lang])
    n = max(len(x) for x in bins().values())
    return list(CLASS_SHARE[lang]), [*q, *[0.0] * (n - len(q)), 1 - sum(q)]


def score(
    docs: DataFrame,
    trusted: DataFrame | None = None,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    min_chars: int = 200,
    min_words: int = 50,
    max_char_distance: float = 0.30,
    max_word_distance: float = 0.45,
    damp: float = 1000.0,
) -> DataFrame:
    """One row per row of ``docs`` with counts, distances, ``base_failed`` and ``kept``.

    ``trusted`` holds ids (``key``) of rows whose texts make the references of their languages, those of at least
    ``min_words`` words; a language without any has its shipped profile, and without one (or null) never fails by
    divergence, with null distances. A null text has no words and fails the base. Repeated rows are scored one by
    one, an empty table gives no rows, extra columns are ignored, string keys stay strings, null keys are kept and
    never trusted. A text is counted whole, in one task.
    """
    spark, table = docs.sparkSession, bins()
    n_common = max(len(x) for x in table.values())
    cols = docs.select((F.col(key) if dict(docs.dtypes)[key] == "string" else F.col(key).cast("long")).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = cols.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([
        ("doc_id", pa.string() if kind == "string" else pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("classes", pa.list_(pa.int64())), ("common", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(1).to_pylist()
            rows = [measure(t, g, table, n_common) for t, g in zip(b.column(2).to_pylist(), langs, strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:], strict=True))], schema=schema)

    counts = cols.mapInArrow(run, f"doc_id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>")
    counts = stage(counts, "quality-counts")
    profiles = [(k, *shipped(k)) for k in COMMON]
    ref = spark.createDataFrame(profiles, "group string, ref_p array<double>, ref_q array<double>")
    if trusted is not None:
        ids = trusted.select(F.col(key).cast(kind).alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
        good = counts.filter((F.col("n_words") >= min_words) & F.col("lang").isNotNull()).join(ids, "doc_id", "left_semi")
        # shares per document, each weighing min(1, words / damp): one long document can't make the reference
        good = good.select("lang", F.least(F.lit(1.0), F.col("n_words") / damp).alias("w"), _share(F.col("classes")).alias("p"), _share(F.col("common")).alias("q"))
        sums = [F.sum(F.col("w") * F.col("p")[i]).alias(f"p{i}") for i in range(len(CLASSES))] + [F.sum(F.col("w") * F.col("q")[i]).alias(f"q{i}") for i in range(n_common + 1)]
        own = good.groupBy(F.col("lang").alias("group")).agg(*sums).select(
            "group", F.array(*(f"p{i}" for i in range(len(CLASSES)))).alias("ref_p"), F.array(*(f"q{i}" for i in range(n_common + 1))).alias("ref_q")
        )
        own = stage(own, "quality-references")
        ref = own.unionByName(ref.join(own.select("group"), "group", "left_anti"))
    both = counts.join(small_side(stage(ref, "quality-profiles")).withColumnRenamed("group", "lang"), "lang", "left")
    known = F.col("ref_p").isNotNull()
    both = both.withColumn("char_distance", F.when(known, _js(_share(F.col("classes")), _share(F.col("ref_p"))))).withColumn(
        "word_distance", F.when(known, _js(_share(F.col("common")), _share(F.col("ref_q"))))
    )
    long_enough = (F.col("n_words") >= min_words) & (F.col("word_chars") >= min_chars)
    apart = (F.col("char_distance") > max_char_distance) | (F.col("word_distance") > max_word_distance)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return both.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~F.coalesce(long_enough & apart, F.lit(False))).alias("kept"), "char_distance", "word_distance",
    )
