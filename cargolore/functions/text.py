"""Text functions over columns: goods descriptions, party names, fragments.

Everything is a composition of built-in functions but :func:`fold_unicode`,
which needs NFKD normalisation and is an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Abbreviations of goods descriptions, in the order they apply.
ABBREVIATIONS = (
    ("w/", "with"), ("w/o", "without"), ("pcs", "pieces"), ("qty", "quantity"), ("mfg", "manufacturing"),
    ("mach", "machinery"), ("equip", "equipment"), ("gds", "goods"), ("comp", "components"), ("assy", "assembly"),
    ("pkg", "package"), ("cont", "containing"), ("unfin", "unfinished"), ("fin", "finished"), ("ss", "stainless steel"),
    ("al", "aluminum"), ("cu", "copper"),
)
# Words that carry no meaning for goods.
STOP_WORDS = ("the", "a", "an", "of", "for", "to", "and", "or", "with")
# Legal forms of companies, as regular expressions.
LEGAL_FORMS = (
    r"ltd", r"llc", r"l\.l\.c\.", r"gmbh", r"inc", r"incorporated", r"corp", r"corporation", r"plc", r"ag", r"a\.g\.",
    r"bv", r"b\.v\.", r"nv", r"n\.v\.", r"sa", r"s\.a\.", r"s\.a\.r\.l\.", r"sarl", r"sas", r"s\.r\.l\.", r"srl",
    r"spa", r"s\.p\.a\.", r"kk", r"k\.k\.", r"pte", r"pvt", r"co", r"co\.", r"company", r"holdings?", r"group",
    r"oao", r"ojsc", r"jsc", r"pjsc", r"zao",
)
MAX_FRAGMENTS, MIN_FRAGMENT = 5, 5


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize(text: Column, compat: bool = False) -> Column:
    """lower-case, keep word characters and ``/ % . - ,``, expand
    abbreviations, drop stop words.  Null gives an empty string.

    ``w/o`` is expanded before ``w/``; ``compat=True`` keeps the order of the
    table, in which ``w/`` is first and only fires before a word character.
    """
    out = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"(?U)[^\w\s/%.\-,]", " ")
    table = list(ABBREVIATIONS)
    if not compat:
        table[:2] = [table[1], table[0]]
    for short, full in table:
        if short.endswith("/"):
            pattern = r"(?U)\bw/\b" if compat else r"(?U)\bw/(?=\s|\w|$)"
        else:
            pattern = rf"(?U)\b{short}\b"
        full = full + " " if not compat and short == "w/" else full
        out = F.regexp_replace(out, pattern, full)
    words = F.filter(F.split(squeeze(out), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_join(words, " ")


@F.pandas_udf(StringType())
def fold_unicode(names: pd.Series) -> pd.Series:
    """NFKD, without combining marks and anything outside ASCII."""

    def fold(s):  # noqa: ANN001, ANN202
        return "".join(c for c in unicodedata.normalize("NFKD", s) if ord(c) < 128) if isinstance(s, str) else ""

    return names.map(fold)


def strip_legal_forms(name: Column) -> Column:
    """without legal forms, wherever they stand, and trailing punctuation, until
    nothing changes: each round that changes a name takes a character at least, so
    as many rounds as the name has characters are enough, and the fold goes idle
    once a round has changed nothing."""
    forms = "|".join(sorted(LEGAL_FORMS, key=len, reverse=True))

    def once(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(c, rf"(?i)\b(?:{forms})(?=\W|$)", ""), r"[\s.,;:!?\-]+$", ""))

    def step(a: Column, _: Column) -> Column:
        return F.when(a["done"], a).otherwise(F.struct(once(a["name"]).alias("name"), (once(a["name"]) == a["name"]).alias("done")))

    whole = F.coalesce(name, F.lit(""))
    return F.aggregate(F.sequence(F.lit(0), F.length(whole)), F.struct(whole.alias("name"), F.lit(False).alias("done")), step, lambda a: a["name"])


def normalize_party(name: Column, fold: bool = True) -> Column:
    """folded, without legal forms, lower-case, squeezed."""
    return squeeze(F.lower(strip_legal_forms(fold_unicode(name) if fold else name)))


def is_short_name(name: Column, min_words: int = 2, min_chars: int = 4) -> Column:
    """too generic to match by likeness: few words or few characters."""
    clean = squeeze(F.coalesce(name, F.lit("")))
    words = F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))
    return (words < min_words) | (F.length(F.regexp_replace(clean, " ", "")) < min_chars)


def words(text: Column) -> Column:
    """lower-cased words of letters and digits, without stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def trigrams(text: Column) -> Column:
    """the distinct trigrams of each word, padded with two spaces before and one after."""
    padded = F.transform(
        F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""),
        lambda w: F.concat(F.lit("  "), w, F.lit(" ")),
    )
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def fragments(text: Column) -> Column:
    """The pieces of a description at ``+ & ; /``, ``plus`` and ``and``, or else
    at commas; pieces of under ``MIN_FRAGMENT`` characters are dropped."""

    def pieces(pattern: str) -> Column:
        return F.filter(F.transform(F.split(text, pattern), lambda p: F.trim(p)), lambda p: p != "")

    hard = pieces(r"(?i)\s*(?:[+&;]|/|\bplus\b|\band\b)\s*")
    return F.filter(F.when(F.size(hard) > 1, hard).otherwise(pieces(r"\s*,\s*")), lambda p: F.length(p) >= MIN_FRAGMENT)


def decompose(text: Column, materials: Column) -> Column:
    """``fragments`` (text, materials) and ``confidence`` that a description
    names several goods.  It does if two to five pieces have materials of their
    own, at least two different ones in all."""
    text = F.coalesce(text, F.lit(""))
    known = F.coalesce(materials, F.array().cast("array<string>"))
    held = F.transform(
        fragments(text),
        lambda p: F.struct(p.alias("text"), F.filter(known, lambda m: (m != "") & F.contains(F.lower(p), F.lower(m))).alias("materials")),
    )
    some = F.filter(held, lambda x: F.size(x["materials"]) > 0)
    distinct = F.size(F.array_distinct(F.flatten(F.transform(some, lambda x: x["materials"]))))
    several = F.size(fragments(text)).between(2, MAX_FRAGMENTS) & (F.size(some) >= 2) & (distinct >= 2)
    whole = F.array(F.struct(text.alias("text"), F.when(text == "", F.array().cast("array<string>")).otherwise(known).alias("materials")))
    return F.struct(
        F.when(several, some).otherwise(whole).alias("fragments"),
        F.when(several, F.least(F.lit(1.0), 0.4 + 0.2 * distinct)).otherwise(F.lit(0.0)).alias("confidence"),
    )


def candidate_text(code: Column, chapter: Column, title: Column, description: Column) -> Column:
    """F16: what a pair scorer sees of a candidate code."""
    head = F.when(F.coalesce(code, F.lit("")) != "", F.concat(F.lit("HS "), code, F.lit(" (ch "), F.coalesce(chapter, F.lit("")), F.lit("):"))).otherwise("HS:")
    second = F.when(description.eqNullSafe(title), None).otherwise(description)
    body = F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(second, F.lit("")))
    return F.concat_ws(" ", head, F.when(body == "", "(no description)").otherwise(body))


def phrases(description: Column, aliases: Column, strategy: Column, limit: int = 10) -> Column:
    """the phrases that a listed commodity is matched by: its description,
    the parts of it (``split_lists``), its aliases (``split_lists`` and
    ``with_aliases``); of 3 characters at least, first spelling wins."""
    none = F.array().cast("array<string>")
    strategy = F.when(strategy.isin("description_only", "with_aliases"), strategy).otherwise("split_lists")
    parts = F.when(strategy == "split_lists", F.split(description, r"(?i)\s*[,;]\s*|\s+and\s+")).otherwise(none)
    more = F.when(strategy.isin("split_lists", "with_aliases"), F.coalesce(aliases, none)).otherwise(none)
    found = F.filter(F.transform(F.concat(F.array(description), parts, more), lambda p: F.trim(p)), lambda p: F.length(p) >= 3)
    keys = F.transform(found, lambda p: F.lower(p))
    return F.slice(F.filter(found, lambda p, i: F.array_position(keys, F.lower(p)) == i + 1), 1, limit)
