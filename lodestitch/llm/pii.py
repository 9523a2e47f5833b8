"""Personal data by a skip-chain conditional random field over the tokens that could hold any.

Four patterns give certain spans. The field labels the other candidate tokens (an @, at least six digits, or a
long mix of letters and digits) as one of the patterns' kinds, as a secret or as none. Its potentials are trained
piecewise, factor by factor, from counts over all documents in which the patterns' spans and the values given to
credential names are the labels (a token without one that repeats a token with one is left out): unary potentials by a multinomial logistic fit to a token's shape, the word before
it and a credential name before it; chain potentials from neighbours and skip potentials from tokens that repeat
(same letters and digits), both as the mutual information of their labels. What repeats a certain span in another
notation (same letters and digits, or a number's digits in one or several tokens, also without its country code)
is tied to it by the nats of so many equal characters by chance; its unary odds are floored, since patterns miss
whole notations. Loopy message passing makes labels agree across a document, and tokens that are then certain
enough are added as spans. All features come from a fixed product of values, so the counts that reach the driver
are bounded. A document is held by one task; everything is linear in its length.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS, "secret")
#: Names whose value is a credential.
CREDENTIALS = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "access-key", "auth")
WORD_BUCKETS = 32
#: Pairs of repeated tokens with equal labels that each label counts as seen before training.
AGREEMENT = 5.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"\S++")
_DIGIT = re.compile(r"[0-9]")
_CORE = re.compile(r"[^0-9A-Za-z@]+")
_NAMED = re.compile("(?:" + "|".join(CREDENTIALS) + r")[\"']?\s?[=:]\s?[\"']?$", re.IGNORECASE)
_BEFORE = re.compile(r"(\S+)\s+\S*$")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the patterns' spans, sorted."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _MAIL.match(text, start) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end if m else 0))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> int:
    digits = sum(c in "0123456789" for c in token)
    size = (digits > 0) + (digits > 5) + (digits > 8) + (digits > 9) + (digits > 13) + (digits > 19)
    dots = min(3, token.count("."))
    hexa = all(c in "0123456789abcdefABCDEF" for c in token)
    out = 0
    for value, n in (
        (size, 7), (dots, 4), ("@" in token, 2), (token.startswith("+"), 2), (any(c.isalpha() for c in token), 2), ("-" in token, 2), (len(token) >= 20, 2), (hexa, 2),
    ):
        out = out * n + int(value)
    return out


def features(text: str, start: int, token: str) -> tuple[int, int, int]:
    """Shape of the token, bucket of the word before it, and whether a credential's name stands before it."""
    lead = text[max(0, start - 40) : start]
    m = _BEFORE.search(lead)
    word = zlib.crc32(m[1].lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS if m else 0
    return shape(token), word, int(bool(_NAMED.search(lead)))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Start, end and text of tokens with an @, at least six digits, or 16 characters with a digit and a letter; outer punctuation is left out."""
    out = []
    if "@" not in text and not _DIGIT.search(text):
        return out
    for m in _RUN.finditer(text):
        t = m[0]
        if len(t) < 6 and "@" not in t:
            continue
        digits = len(_DIGIT.findall(t))
        if "@" in t or digits >= 6 or digits and len(t) >= 16:
            core = t.strip(".,;:!?\"'()[]{}<>")
            if core and ("@" in t or digits >= 6 or any(c.isalpha() for c in core)):
                start = m.start() + t.index(core)
                out.append((start, start + len(core), core))
    return out


_NUMBER = re.compile(r"[0-9]+(?:[ ().+/-]{1,3}[0-9]+)*+")
_FLOOR = -10.0


def number_keys(digits: str, kind: int) -> list[str]:
    """The digits of a card or phone number; a phone number's also without a country code of one to three digits."""
    digits = digits.lstrip("0")
    return [digits, *(digits[c:].lstrip("0") for c in (1, 2, 3) if kind == 3 and len(digits[c:].lstrip("0")) >= 9)]


def repeats(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, equal digits) of numbers outside ``spans`` that a card or phone span has too."""
    known: dict[str, int] = {}
    for a, k, b in spans:
        if k in (2, 3):
            for d in number_keys("".join(_DIGIT.findall(text[a:b])), k):
                known.setdefault(d, k)
    out, j = [], 0
    for m in _NUMBER.finditer(text) if known else ():
        groups = [(m.start() + g.start(), m.start() + g.end(), g[0]) for g in re.finditer("[0-9]+", m[0])]
        i = 0
        while i < len(groups):
            said, best = "", None
            for n in range(i, len(groups)):
                said += groups[n][2]
                if len(said) > 24:
                    break
                if (d := said.lstrip("0")) in known:
                    best = n, known[d], len(d)
            if best:
                a, b = groups[i][0], groups[best[0]][1]
                while j < len(spans) and spans[j][2] <= a:
                    j += 1
                if j == len(spans) or spans[j][0] >= b:
                    out.append((a, b, best[1], best[2]))
                i = best[0]
            i += 1
    return out


def labels_of(tokens: list[tuple[int, int, str]], spans: list[tuple[int, int, int]]) -> list[int]:
    """The kind (1 on) of the span that overlaps each token, else 0; both sides are in order of their starts."""
    out, j, open_ = [], 0, []
    for a, b, _ in tokens:
        while j < len(spans) and spans[j][0] < b:
            open_.append(spans[j])
            j += 1
        open_ = [s for s in open_ if s[2] > a]
        out.append(min((s[1] for s in open_), default=-1) + 1)
    return out


def twins(tokens: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Each token with its last repetition before it: same letters and digits."""
    last: dict[str, int] = {}
    out = []
    for i, x in enumerate(tokens):
        c = _CORE.sub("", x[2]).lower()
        if c in last:
            out.append((last[c], i))
        last[c] = i
    return out


def neighbours(tokens: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    return [(i, i + 1) for i in range(len(tokens) - 1) if tokens[i + 1][0] - tokens[i][1] <= 2]


def infer(unary: np.ndarray, edges: list[tuple[int, int]], potentials: np.ndarray, rounds: int = 60, close: float = 1e-6) -> np.ndarray:
    """Marginals by damped loopy belief propagation; ``potentials`` has a symmetric matrix of logs for each edge."""

    def share(x: np.ndarray) -> np.ndarray:
        p = np.exp(x - x.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    if not len(edges):
        return share(unary)
    e = np.array(edges, int).reshape(-1, 2)
    src, dst = np.concatenate((e[:, 0], e[:, 1])), np.concatenate((e[:, 1], e[:, 0]))
    back = np.concatenate((np.arange(len(e)) + len(e), np.arange(len(e))))
    w = np.concatenate((potentials, potentials))
    msg = np.zeros((len(src), unary.shape[1]))
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, dst, msg)
        out = (total[src] - msg[back])[:, :, None] + w
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        step = np.abs(new - msg).max()
        msg = 0.5 * msg + 0.5 * new
        if step < close:
            break
    total = unary.copy()
    np.add.at(total, dst, msg)
    return share(total)


def given_labels(text: str, tokens: list[tuple[int, int, str]], feats: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """The labels to learn from: the patterns' kinds, and secrets where a credential's name stands before."""
    secret = LABELS.index("secret")
    return [y or (secret if f[2] and len(x[2]) >= 8 else 0) for x, f, y in zip(tokens, feats, labels_of(tokens, spans), strict=True)]


class Field:
    """Potentials fitted to counts: unary[(shape, word, named)] of label counts, and label pairs of both kinds of edges."""

    def __init__(self, unary: dict[tuple[int, int, int], np.ndarray], chain: np.ndarray, skip: np.ndarray, steps: int = 300):
        n = len(LABELS)
        self.place: tuple[dict[int, int], ...] = tuple({v: i for i, v in enumerate(sorted({f[j] for f in unary}))} for j in range(3))
        sizes = [len(p) for p in self.place]
        self.weights = [np.zeros((k, n)) for k in sizes]
        counts = np.array(list(unary.values()), float).reshape(-1, n)
        self.bias = np.log((counts.sum(0) + ([1.0] + [0.1] * (n - 1))) / (counts.sum() + 1 + 0.1 * (n - 1)))
        if unary:
            at = [np.array([self.place[j][f[j]] for f in unary]) for j in range(3)]
            size = counts.sum(1, keepdims=True)
            heft = [np.zeros(k) for k in sizes]
            for j in range(3):
                np.add.at(heft[j], at[j], size[:, 0])
            for _ in range(steps):  # each block moves by its own gradient over its own mass: a diagonal bound of the Hessian
                z = self.bias + sum(w[i] for w, i in zip(self.weights, at, strict=True))
                p = np.exp(z - z.max(1, keepdims=True))
                gap = counts - size * p / p.sum(1, keepdims=True)
                for j, w in enumerate(self.weights):
                    g = np.zeros_like(w)
                    np.add.at(g, at[j], gap)
                    w += (g - 0.02 * w) / (0.5 * heft[j][:, None] + 1.0)
        self.chain, self.skip = self.tie(chain), self.tie(skip + AGREEMENT * np.eye(n))

    @staticmethod
    def tie(pairs: np.ndarray) -> np.ndarray:
        """Mutual information, in nats, of each pair of labels at the ends of an edge; unseen pairs are smoothed."""
        both = pairs + pairs.T
        ends = both.sum(0) + 1.0
        smooth = np.outer(ends, ends) / ends.sum() ** 2
        joint = (both + smooth) / (both.sum() + smooth.sum())
        return np.log(joint) - np.log(np.outer(ends, ends) / ends.sum() ** 2)

    def unary(self, f: tuple[int, int, int]) -> np.ndarray:
        z = self.bias.copy()
        for v, place, w in zip(f, self.place, self.weights, strict=True):
            if v in place:
                z += w[place[v]]
        z -= z.max()
        return z - np.log(np.exp(z).sum())


def train(texts: DataFrame) -> Field:
    """A field from counts over all rows; what reaches the driver is bounded by the number of feature values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                tokens = candidates(t)
                if tokens:
                    feats = [features(t, x[0], x[2]) for x in tokens]
                    y = given_labels(t, tokens, feats, base_spans(t))
                    same = twins(tokens)
                    masked = {j if y[i] else i for i, j in same if bool(y[i]) != bool(y[j])}
                    seen.update((0, *f, k) for i, (f, k) in enumerate(zip(feats, y, strict=True)) if i not in masked)
                    for kind, edges in ((1, neighbours(tokens)), (2, same)):
                        seen.update((kind, 0, 0, y[i], y[j]) for i, j in edges if i not in masked and j not in masked)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((*k, n) for k, n in seen.items()), strict=True)], ["kind", "a", "b", "c", "label", "n"])

    unary: dict[tuple[int, int, int], np.ndarray] = {}
    pairs = np.zeros((3, len(LABELS), len(LABELS)))
    for r in texts.mapInArrow(run, "kind long, a long, b long, c long, label long, n long").groupBy("kind", "a", "b", "c", "label").agg(F.sum("n").alias("n")).collect():
        if r["kind"]:
            pairs[r["kind"], r["c"], r["label"]] += r["n"]
        else:
            unary.setdefault((r["a"], r["b"], r["c"]), np.zeros(len(LABELS)))[r["label"]] += r["n"]
    return Field(dict(sorted(unary.items())), pairs[1], pairs[2])


def label(t: str, field: Field, min_probability: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The patterns' spans, and those with what the field adds."""
    base = base_spans(t)
    tokens = candidates(t)
    again = repeats(t, base)
    if again:  # a repeated number is one candidate, in place of the tokens that it meets
        met = labels_of(tokens, [(a, 0, b) for a, b, *_ in again])
        given = labels_of(tokens, base)
        tokens = sorted([*(x for x, y, z in zip(tokens, met, given, strict=True) if not y or z), *((a, b, t[a:b]) for a, b, *_ in again)])
    given = labels_of(tokens, base)
    if all(given):
        return base, base
    unary = np.array([field.unary(features(t, x[0], x[2])) for x in tokens])
    sure = np.array(given) > 0
    unary[sure] = -30.0
    unary[sure, np.array(given)[sure]] = 0.0
    chain, skip = neighbours(tokens), twins(tokens)
    edges, weights = [*chain, *skip], [field.chain] * len(chain) + [field.skip] * len(skip)
    # ties to certain spans, each of which is a certain node at the end
    ties = {(a, b): (kind + 1, n) for a, b, kind, n in again}
    cores = {_CORE.sub("", t[a:b]).lower(): k + 1 for a, k, b in base}
    cores.update((_CORE.sub("", x[2]).lower(), y) for x, y in zip(tokens, given, strict=True) if y)
    extra = []
    for i, x in enumerate(tokens):
        c = _CORE.sub("", x[2]).lower()
        kind, n = ties.get(x[:2], (cores.get(c, 0), len(c)))
        if kind and not given[i]:
            unary[i] = np.maximum(unary[i], _FLOOR)
            node = np.full(len(LABELS), -30.0)
            node[kind] = 0.0
            edges.append((i, len(tokens) + len(extra)))
            extra.append(node)
            weights.append(np.eye(len(LABELS)) * min(25.0, math.log(10) * n))
    p = infer(np.vstack([unary, *extra]), edges, np.array(weights).reshape(-1, len(LABELS), len(LABELS)))[: len(tokens)]
    best = p.argmax(1)
    found = [(x[0], int(best[i]) - 1, x[1]) for i, x in enumerate(tokens) if not given[i] and best[i] and p[i, best[i]] >= min_probability]
    return base, sorted([*base, *found])


def replaced(t: str, spans: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for a, k, b in spans:
        if a >= at:
            parts += [t[at:a], f"<{LABELS[k + 1].upper()}>"]
        at = max(at, b)
    return "".join([*parts, t[at:]])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", min_probability: float = 0.9, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: counts of the patterns' spans, their digest, all spans and their number.

    A null text is empty. Repeated rows give equal rows, an empty table gives no rows, a null key stays null and
    extra columns are ignored. A string key stays a string, any other is a long. Spans that the field adds never
    overlap those of the patterns. ``keep_text`` adds ``redacted``: the text with each span replaced by its kind in
    brackets. Very long texts are held by one task and labelled whole.
    """
    own = F.col(key) if dict(docs.dtypes)[key] == "string" else F.col(key).cast("long")
    rows = docs.select(own.alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    field = train(rows.select("text"))

    def one(t: str) -> tuple:
        base, spans = label(t, field, min_probability)
        n = Counter(s[1] for s in base)
        said = [",".join(f"{LABELS[k + 1]}:{a}:{b}" for a, k, b in s) for s in (base, spans)]
        out = [n[0], n[1], n[2], n[3], hashlib.sha256(said[0].encode()).hexdigest(), said[1], len(spans)]
        return tuple(out + [replaced(t, spans)] * keep_text)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                cols = list(zip(*map(one, part.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, x) for c, x in zip(cols, types, strict=False))], names + ["redacted"] * keep_text)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long" + ", redacted string" * keep_text
    return rows.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", min_probability: float = 0.9) -> DataFrame:
    """``docs`` with the spans of each text replaced; all rows and columns stay, null texts too, whatever the columns' names."""
    field = train(docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [None if t is None else replaced(t, label(t, field, min_probability)[1]) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()) if i == at else x for i, x in enumerate(b.columns)], names)

    return docs.select(*(F.col(c).cast("string") if c == text else F.col(c) for c in names)).mapInArrow(run, docs.withColumn(text, F.col(text).cast("string")).schema)
