"""Word and k-gram expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters_and_digits(text: Column) -> Column:
    """Lower-cased words of ``text`` with one blank between them: runs of 0-9, a-z and characters beyond ASCII."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def blank_split(joined: Column) -> Column:
    """Words of a string with one blank between words; none for the empty string."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " ", -1))


def once(value: Column) -> Column:
    """``value`` as a generated column: computed once per row, never copied into the lambdas that use it."""
    return F.explode(F.array(value))


def rolling(words: str, k: int) -> Column:
    """Hashes of all runs of ``k`` words of the array column ``words``, by start; none for fewer words."""
    n = F.size(words)

    def one(i: Column) -> Column:
        return F.xxhash64(*(F.get(F.col(words), i + j) for j in range(k)))

    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), one)).otherwise(F.array().cast("array<bigint>"))


def phrase_starts(joined: str, words: str, phrase: str) -> Column:
    """Starts of a phrase in the array ``words``; only texts that hold it are searched word by word."""
    p = phrase.split()

    def here(i: Column) -> Column:
        found = F.get(F.col(words), i) == p[0]
        for j, w in enumerate(p[1:], 1):
            found = found & (F.get(F.col(words), i + j) == w)
        return found

    padded = F.concat(F.lit(" "), F.col(joined), F.lit(" "))
    return F.when(F.instr(padded, f" {phrase} ") > 0, F.filter(F.sequence(F.lit(0), F.size(words) - len(p)), here)).otherwise(
        F.array().cast("array<int>")
    )
