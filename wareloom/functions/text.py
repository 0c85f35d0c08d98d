"""Text expressions: trimming, matching, and cutting a page into blocks.

A page is one row. Line and block work stays inside that row (split plus
higher-order functions), so page text is never shuffled or re-sorted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every character that counts as white space, no-break and other Unicode blanks among them.
_WIDE_BLANKS = "\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANKS = " \t\n\r\f\x0b" + _WIDE_BLANKS
INLINE_BLANK = r"[^\S\n]"


def strip(c: Column, chars: str = BLANKS) -> Column:
    return F.btrim(c, F.lit(chars))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; text of one-byte characters only has few kinds of it to look for."""

    def squeezed(x: Column) -> Column:
        narrow = F.regexp_replace(x, r"[\s\x1c-\x1f]+", " ")
        return F.when(F.octet_length(x) == F.length(x), narrow).otherwise(F.regexp_replace(x, rf"[\s{_WIDE_BLANKS}]+", " "))

    return let(c, squeezed)


def strip_tags(c: Column) -> Column:
    return strip(squeeze(F.regexp_replace(c, r"<[^>]+>", "")))


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match, or NULL (not the empty string) when there is none."""
    return null_if_empty(F.regexp_extract(c, pattern, group))


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """Whether any of the words occurs. Plain searches: a regular expression tries every word at every place."""
    return let(c, lambda x: any_of(F.contains(x, F.lit(w)) for w in words))


def count_contained(c: Column, words: Iterable[str]) -> Column:
    """How many of the words occur in the text, each counted once."""
    return reduce(lambda a, b: a + b, (F.contains(c, F.lit(w)).cast("int") for w in words))


def matches_any(c: Column, patterns: Iterable[str], flags: str = "") -> Column:
    return c.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def count_matching(c: Column, patterns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, (c.rlike(p).cast("int") for p in patterns))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def total(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def first_hit(rules: Iterable[tuple[Column, Column]], default: Column) -> Column:
    """Ordered rules as one CASE: the first true test decides."""
    out = None
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def blocks(c: Column, header: str) -> Column:
    """Cut a text before every line whose trimmed form matches `header`.

    Element 0 is what stands before the first header; every later element
    starts with its header line.
    """
    cut = rf"\n(?={INLINE_BLANK}*(?:{header}){INLINE_BLANK}*(?:\n|\z))"
    return F.split(F.concat(F.lit("\n"), c), cut)


def first_of_each(items: Column, key) -> Column:
    """Drop array items whose key was seen at an earlier position."""

    def pick(xs: Column) -> Column:
        keys = F.transform(xs, key)
        return let(keys, lambda ks: F.filter(xs, lambda x, i: F.array_position(ks, F.get(ks, i)) == i + 1))

    return let(items, pick)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def unnest(df: DataFrame, keep: list[str], array: Column, pos: str = "pos", item: str = "item") -> DataFrame:
    """One row per array item, with its position.

    The outer form is used and empty rows are dropped behind it: the inner
    form makes the optimizer add a size test below the projection, which
    would work out the whole array a second and third time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())
