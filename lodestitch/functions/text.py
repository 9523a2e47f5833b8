"""Term, id and text functions: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestitch.constants import ACCEPTABLE_DOMAINS, CHILDREN_SHOWN


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_key(term: str) -> Column:
    """Trimmed, lower-cased term: the key of exact lexical matches."""
    return F.lower(trim(F.col(term).cast("string")))


def tokens(term: str) -> Column:
    """Lower-cased blank-separated tokens; none for a blank or null term."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(term).cast("string"), F.lit(""))), r"\s+"), lambda x: x != "")


def tag_of(label: Column) -> Column:
    return F.regexp_extract(trim(F.coalesce(label, F.lit(""))), r"\(([^)]+)\)$", 1)


def semantic_tag(label: str) -> Column:
    """The last parenthesised tag of a label; empty where there is none."""
    return tag_of(F.col(label))


def strip_tag(label: str) -> Column:
    """The label without its last parenthesised tag."""
    return F.regexp_replace(trim(F.col(label)), r"(?U)\s*\([^)]+\)$", "")


def fsn_term(attribute: str, value: str) -> Column:
    """Labels lose their tag; other terms stay."""
    return F.when(F.col(attribute) == "label", strip_tag(value)).otherwise(F.col(value))


def domain_ok(tag: Column) -> Column:
    return tag.isin(*ACCEPTABLE_DOMAINS)


def representative_label(labels: str) -> Column:
    """The first label with an acceptable tag, else the first, else null."""
    fit = F.filter(F.col(labels), lambda x: domain_ok(tag_of(x)))
    return F.coalesce(F.get(fit, F.lit(0)), F.get(F.col(labels), F.lit(0)))


def parse_id(text: str) -> Column:
    """A positive integer id as a string; null for compositions, fractions and other text.

    Plain digits never pass through a float. Scientific notation counts where its value is whole.
    """
    t = trim(F.col(text).cast("string"))
    plain = F.regexp_extract(t, r"^\+?0*([1-9][0-9]*)$", 1)
    science = t.rlike(r"^[+-]?[0-9]*\.?[0-9]+[eE][+-]?[0-9]+$")
    composed = (t.contains(":") | t.contains("+")) & ~science
    number = F.when(t.rlike(r"^[0-9]+\.[0-9]*$") | science, F.expr(f"try_cast(`{text}` AS double)"))
    whole = F.when((number > 0) & (number < 1e18) & (number == F.floor(number)), number.cast("decimal(38,0)").cast("string"))
    return F.when(composed, F.lit(None)).when(plain != "", plain).otherwise(whole)


def split_expression(text: str) -> Column:
    """What stands before the first blank and bar."""
    return F.substring_index(F.col(text), " |", 1)


def quote_list(values: Column) -> Column:
    """Quoted and comma-joined; ``"None"`` in quotes where there is nothing."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(F.transform(values, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")).otherwise('"None"')


def children_text(labels: Column) -> Column:
    """The first children's labels; the total where more exist."""
    n = F.size(labels)
    shown = quote_list(F.slice(labels, 1, CHILDREN_SHOWN))
    return F.when(n > CHILDREN_SHOWN, F.concat(shown, F.lit(f" ({CHILDREN_SHOWN} of "), n.cast("string"), F.lit(" shown)"))).otherwise(shown)


def share(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def outcome(code: Column) -> Column:
    """Accepted, removed, review or conflict."""
    return F.when(code == 10, "accepted").when(code == 0, "removed").when(code.isin(8, 9), "review").when(code.isNotNull(), "conflict")
