"""English stems (the public Porter2 rules) and the two text configurations of full-text search."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# English stop words of full-text search.
ENGLISH_STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
# Whole words with stems of their own, and words that end after the first step.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffixes and what takes their place.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWEL = re.compile(r"[aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin in which suffixes may go."""
    first = re.match(r"gener|commun|arsen", word)
    found = first.end() if first else ((m := _REGION.search(word)) and m.end()) or len(word)
    return found, ((m := _REGION.search(word, found)) and m.end()) or len(word)


def _longest(word: str, suffixes) -> str | None:  # noqa: ANN001
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    suffix = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return w
    stem = w[: -len(suffix)]
    if suffix.startswith("eed"):
        return stem + "ee" if len(stem) >= r1 else w
    if not _VOWEL.search(stem):
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
        return stem[:-1]
    return stem + "e" if len(stem) <= r1 and _SHORT.search(stem) else stem


def stem(word: str) -> str:
    """The stem of a lower-case word; words with other letters than a-z stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(r"(?<=[aeiouy])y|^y", "Y", word)
    r1, r2 = _regions(w)
    w = _plural(w)
    if w in FINISHED:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"
    if (s := _longest(w, SECOND)) and len(w) - len(s) >= r1 and not (s == "ogi" and w[-4:-3] != "l") and not (s == "li" and w[-3:-2] not in set("cdeghkmnrt")):
        w = w[: -len(s)] + SECOND[s]
    if (s := _longest(w, THIRD)) and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + THIRD[s]
    if (s := _longest(w, FOURTH)) and len(w) - len(s) >= r2 and not (s == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def plain_words(text: Column) -> Column:
    """F20, the plain configuration: all words (letters and digits of any script) in
    lower case, in order, so that a word's place in the list is its position."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{M}]+"), 0)


@F.pandas_udf(ArrayType(StringType()))
def _english(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def lexeme(w: str) -> str:
        if w not in known:
            known[w] = "" if w in ENGLISH_STOP_WORDS else stem(w)
        return known[w]

    return words.map(lambda own: None if own is None else [lexeme(w) for w in own])


def lexemes(text: Column, config: str = "english") -> Column:
    """the lexemes of a text by position.  ``english``: stems, with an empty text at
    the places of stop words; ``simple``: the words themselves, stop words too."""
    if config not in ("english", "simple"):
        raise ValueError(f"no text configuration {config!r}")
    return _english(plain_words(text)) if config == "english" else plain_words(text)
