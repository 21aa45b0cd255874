"""Functions over tariff codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(code: Column) -> Column:
    """digits only."""
    return F.regexp_replace(code, "[^0-9]", "")


def to_level(code: Column) -> Column:
    """F8: six, four or two leading digits, whichever the code has; else null."""
    d = digits(code)
    return F.when(F.length(d) >= 6, F.substring(d, 1, 6)).when(F.length(d).isin(2, 4), d)


def six_digits(code: Column) -> Column:
    """the first six digits, or null if there are fewer."""
    return F.when(F.length(digits(code)) >= 6, F.substring(digits(code), 1, 6))


def level_codes(codes: Column) -> Column:
    """usable codes of a list, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(codes, to_level), lambda c: c.isNotNull()))


def split_codes(text: Column) -> Column:
    """codes separated by ``;``, ``/`` or ``,``."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;/,]"), lambda c: F.trim(c)), lambda c: c != "")


def prefixes(code: Column) -> Column:
    """the code's chapter, heading and subheading as far as it has them."""
    return F.filter(F.array(*(F.when(F.length(code) >= n, F.substring(code, 1, n)) for n in (2, 4, 6))), lambda c: c.isNotNull())


def grade(code: Column, gold: Column) -> Column:
    """Relevance of a code for a gold code: 4 equal, 3 same heading, 2 same
    chapter, 1 a neighbouring chapter, else 0."""
    near = F.abs(F.substring(code, 1, 2).try_cast("int") - F.substring(gold, 1, 2).try_cast("int")) == 1
    return (
        F.when(code == gold, 4).when(F.substring(code, 1, 4) == F.substring(gold, 1, 4), 3)
        .when(F.substring(code, 1, 2) == F.substring(gold, 1, 2), 2).when(near, 1).otherwise(0)
    )


def level_label(level: Column, code: Column) -> Column:
    """Chapter, heading or subheading, by level or else by length."""
    n = F.when(level.isin(2, 4, 6), level).otherwise(F.length(code))
    return F.when(n == 2, "chapter").when(n == 4, "heading").otherwise("subheading")


def found_in_html(html: Column) -> Column:
    """codes of the form ``1234.56`` with optional further digits, as six digits."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"\b(\d{4}\.\d{2}(?:\.\d{2,4})?)\b"), 1), lambda c: F.substring(digits(c), 1, 6))
