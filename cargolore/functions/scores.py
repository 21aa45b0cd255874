"""Numeric functions of ranking and similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargolore.functions.text import set_similarity, trigrams, words

# The order of the fusion features and their linear weights.
FEATURE_WEIGHTS = {
    "dense_similarity": 0.20, "sparse_score": 0.10, "entity_overlap_score": 0.15, "cross_encoder_score": 0.45,
    "chapter_prior": 0.05, "candidate_depth": 0.0, "top1_minus_top2_gap": 0.05, "ce_was_evaluated": 0.0,
}

#: A pair scorer takes two text columns and gives a logit.
PairScorer = Callable[[Column, Column], Column]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.  (An expression that a lambda
    function reads would be computed for each element.)"""
    return F.transform(F.array(value), body)[0]


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def lexical_sets(text: Column) -> Column:
    """What the default scorer reads of a text: its sets of words and trigrams."""
    return F.struct(F.array_distinct(words(text)).alias("words"), trigrams(text).alias("grams"))


def compare_sets(one: Column, two: Column) -> Column:
    return 6 * (0.6 * set_similarity(one["words"], two["words"]) + 0.4 * set_similarity(one["grams"], two["grams"])) - 3


def lexical_logit(query: Column, text: Column) -> Column:
    """The default pair scorer: a logit from shared words and shared trigrams.

    :func:`cargolore.functions.models.pair_scorer` makes scorers of models.  Where many
    pairs are scored, ``prepare`` makes each text's sets once, and ``compare`` takes two."""
    shared = 0.6 * set_similarity(F.array_distinct(words(query)), F.array_distinct(words(text))) + 0.4 * set_similarity(trigrams(query), trigrams(text))
    return 6 * shared - 3


lexical_logit.prepare, lexical_logit.compare = lexical_sets, compare_sets
