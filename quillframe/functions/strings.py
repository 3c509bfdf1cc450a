"""String functions, from columns to columns. Nulls are passed on; what is no string is cast to one."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = " \t\n\r"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text(c: Column) -> Column:
    return c.cast("string")


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def _quoted(literal: str) -> str:
    """A literal as a Java pattern."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def upper(c: Column) -> Column:
    return F.upper(text(c))


def lower(c: Column) -> Column:
    return F.lower(text(c))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text(c), r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+\z", "")


def lstrip(c: Column) -> Column:
    return F.ltrim(text(c), F.lit(_SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(text(c), F.lit(_SPACES))


def length(c: Column) -> Column:
    """The number of bytes in UTF-8."""
    return F.octet_length(text(c)).cast("long")


def contains(c: Column, pattern: str) -> Column:
    """Whether the pattern is found; what is no valid pattern is taken literally."""
    return text(c).rlike(pattern) if _valid(pattern) else text(c).contains(pattern)


def starts_with(c: Column, prefix: str) -> Column:
    return text(c).startswith(prefix)


def ends_with(c: Column, suffix: str) -> Column:
    return text(c).endswith(suffix)


def replace(c: Column, old: str, new: str) -> Column:
    return F.replace(text(c), F.lit(old), F.lit(new))


def replace_regex(c: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(text(c), pattern, new) if _valid(pattern) else replace(c, pattern, new)


def split(c: Column, separator: str, n: int) -> Column:
    """The ``n``-th part, from 0; empty where there is none."""
    if n < 0:
        return F.when(c.isNotNull(), F.lit(""))
    return F.split_part(text(c), F.lit(separator), F.lit(n + 1))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(text(c), F.lit(pattern if _valid(pattern) else _quoted(pattern))).cast("long")


def pad(c: Column, width: int, fill: str = " ", side: str = "left") -> Column:
    """Fill up to ``width`` bytes on the given side; longer texts stay whole."""
    s = text(c)
    more = F.repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(width) - F.octet_length(s)))
    return F.concat(s, more) if side == "right" else F.concat(more, s)


def zero_fill(c: Column, width: int) -> Column:
    return pad(c, width, "0", "left")


def extract(c: Column, pattern: str) -> Column:
    """The first group of the first match, the whole match if there is no group, empty if none matches."""
    groups = re.compile(pattern).groups
    return F.regexp_extract(text(c), pattern, 1 if groups else 0)


def extract_all(c: Column, pattern: str) -> Column:
    """All whole matches, joined by commas."""
    return F.array_join(F.regexp_extract_all(text(c), F.lit(pattern), F.lit(0)), ",")


def title(c: Column) -> Column:
    """The first letter of each word in upper case, the rest as it is."""
    head = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    # words and what stands between them, in turn
    parts = F.regexp_extract_all(text(c), F.lit(r"\s+|\S+"), F.lit(0))
    return F.array_join(F.transform(parts, head), "")


def swap_case(c: Column) -> Column:
    return F.translate(text(c), _LOWER + _UPPER, _UPPER + _LOWER)


def is_numeric(c: Column) -> Column:
    """Whether the text is a decimal or exponent number, inf or nan, as a whole."""
    return text(c).rlike(r"(?i)\A[+-]?(inf|infinity|nan|(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?)\z")


def is_alpha(c: Column) -> Column:
    return text(c).rlike(r"\A[A-Za-z]+\z")


def is_digit(c: Column) -> Column:
    return text(c).rlike(r"\A[0-9]+\z")


def is_empty(c: Column) -> Column:
    return text(c) == ""


def cat(c: Column, separator: str, order_by: list[Column]) -> Column:
    """An aggregate: all texts that aren't null, in order, with the separator between them."""
    rows = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order_by)], text(c).alias("v")))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)
