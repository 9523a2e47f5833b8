"""Normalised tokens of terms: lower case, lemmas, stop words, stems."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that are never removed, as they change what a term means.
PROTECTED = frozenset(
    (
        "no not without none nothing never neither nor cannot"  # negation and absence
        " one two three four five six eight nine ten eleven twelve fifteen twenty forty fifty sixty hundred first third"  # numbers
        " back front behind side top bottom above below under over up down between within across beyond both either each"  # place
        " less more most least few several many much all only full empty whole serious"  # degree
        " before after during again once often always sometimes"  # time
        " move"
    ).split()
)

# Common English words without a meaning of their own in terms; the protected ones are among them.
STOP_WORDS = PROTECTED | frozenset(
    "a about after all also although am among an and any are as at be because been before being between both but by can could did do does doing due during each either else every few for from further had has have having he her here hers him his how i if in into is it its itself"
    " just least less many may me might more most much must my neither no nor not of off often on once one only or other our out over own per quite rather same several she should since so some such than that the their them then there these they this those through to too two"
    " under until up upon us used using various very via was we were what when where whether which while who whom whose why will with within without would yet you your".split()
)
#: Letters, digits and what stands inside a word; other characters part tokens.
_TOKEN = r"[\p{L}\p{N}]+(?:['’.\-][\p{L}\p{N}]+)*"

# Endings and what replaces them, in the steps of Porter's algorithm (1980).
_STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """A letter ``c`` or ``v`` for each consonant and vowel; y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(w: str) -> bool:
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _longest(w: str, endings: dict[str, str] | tuple[str, ...]) -> str:
    return max((e for e in endings if w.endswith(e)), key=len, default="")


def stem(w: str) -> str:
    """The stem of a lower-case English word by Porter's rules; words with other characters, or of one or two letters, stay."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    # Plurals.
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # Past tense and gerund.
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((len(e) for e in ("ed", "ing") if w.endswith(e)), 0)
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _shape(w).endswith("cc") and w[-1] == w[-2] and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _ends_cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    # Derived forms, twice.
    for endings in (_STEP_2, _STEP_3):
        e = _longest(w, endings)
        if e and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + endings[e]
    e = _longest(w, _STEP_4)
    if e and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[-4] in "st"):
        w = w[: -len(e)]
    # Final e and double l.
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _ends_cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@dataclass(frozen=True)
class TokenNormalizer:
    """Terms as lists of tokens: lower case, lemma, stop words left out, stem, each step on request.

    Stop words are those of ``stop_words`` that ``protected`` does not name. ``lemmas`` is a table (token, lemma) of
    any size; its first lemma in text order counts, tokens without one stay. Protected words are not stemmed. Python
    sees every distinct token once, however many terms hold it.
    """

    lower: bool = True
    stem: bool = True
    remove: bool = True
    stop_words: frozenset[str] = STOP_WORDS
    protected: frozenset[str] = PROTECTED
    lemmas: DataFrame | None = field(default=None, compare=False)

    def forms(self, tokens: DataFrame) -> DataFrame:
        """(token, form) of the distinct ``token``s; a removed one has no row."""
        t = tokens.select("token").distinct()
        form = F.col("token")
        if self.lemmas is not None:
            t = t.join(self.lemmas.groupBy("token").agg(F.min("lemma").alias("lemma")), "token", "left")
            form = F.coalesce("lemma", "token")
        t = t.select("token", form.alias("form"))
        if self.remove:
            gone = sorted(self.stop_words - self.protected)
            t = t.filter(~F.lower("form").isin(gone) & ~(F.lower("token").isin(gone)))
        if not self.stem:
            return t
        kept = self.protected

        @F.pandas_udf("string")
        def stems(words: pd.Series) -> pd.Series:
            return words.map(lambda w: w if w in kept else stem(w))

        return t.select("token", stems("form").alias("form"))

    def normalize(self, terms: DataFrame, term: str = "term") -> DataFrame:
        """``terms`` with ``tokens``, in the order of the text, repeats included; none for null and blank terms.

        The distinct terms are cut into tokens and put together again by their text, so a term that stands in many
        rows is worked on once.
        """
        text = F.lower(F.col("_t")) if self.lower else F.col("_t")
        distinct = terms.select(F.col(term).cast("string").alias("_t")).filter("_t IS NOT NULL").distinct()
        cut = distinct.select("_t", F.posexplode(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
        met = cut.join(self.forms(cut), "token")
        lists = met.groupBy("_t").agg(F.sort_array(F.collect_list(F.struct("pos", "form")))["form"].alias("tokens"))
        out = terms.drop("tokens").join(lists, F.col(term).cast("string") == F.col("_t"), "left").drop("_t")
        return out.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
