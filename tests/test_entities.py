"""Gazetteer terms of several words, by automaton and by join."""

import random

import pytest
from pyspark.sql import functions as F

from cargolore.functions.automaton import Automaton, leftmost_longest, split_words
from cargolore.operators import entities


def plain(text, terms):
    """(label, term, start, end) by trying every term at every word."""
    words = split_words(text)
    out = []
    for label in {t[0] for t in terms}:
        at = 0
        while at < len(words):
            fits = [t for lb, t in terms if lb == label and [w for w, _, _ in words[at : at + len(t.split())]] == t.split()]
            if fits:
                best = max(fits, key=lambda t: len(t.split()))
                last = at + len(best.split()) - 1
                out.append((label, best, words[at][1], words[last][2]))
                at = last + 1
            else:
                at += 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(30))
def test_automaton_finds_every_occurrence(seed):
    r = random.Random(seed)
    terms = list({tuple(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(12)})
    words = [r.choice("abc") for _ in range(60)]
    got = sorted(Automaton([list(t) for t in terms]).matches(words))
    want = sorted((n, i, i + len(t) - 1) for n, t in enumerate(terms) for i in range(len(words)) if tuple(words[i : i + len(t)]) == t)
    assert got == want
    kept = leftmost_longest([(a, b, n) for n, a, b in got])
    assert all(x[1] < y[0] for x, y in zip(kept, kept[1:], strict=False))


@pytest.mark.parametrize("limit", [entities.AUTOMATON_CHARS, 0])
def test_spans_by_automaton_and_by_join(spark, limit):
    r = random.Random(4)
    vocabulary = ["hot", "rolled", "steel", "coil", "Größe", "éclair", "of", "x1"]
    terms = [(label, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 7))).lower()) for label in ("material", "form") for _ in range(25)]
    texts = ["".join(r.choice(vocabulary).upper() + r.choice([" ", ", ", "-", "_", " / "]) for _ in range(r.randrange(30))) for _ in range(80)]
    rows = [(i % 50, t) for i, t in enumerate(texts)] + [(99, None), (None, texts[0])]
    table = spark.createDataFrame([(lb, t.replace(" ", "--"), 0.9) for lb, t in terms] + [("form", "steel", 0.1), ("form", "?", 0.9), (None, "steel", 0.9)], "label string, term string, score double")
    got = entities.gazetteer_spans(spark.createDataFrame(rows, "query_id int, text string"), table, automaton_chars=limit).collect()
    want = [(i, *x) for i, t in rows for x in plain(t, terms)]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((g.query_id, g.label, g.text, g.start, g.end) for g in got), key=key) == sorted(want, key=key)
    assert all([w for w, _, _ in split_words(g.surface)] == g.text.split() for g in got)


def test_shapes_of_spans(spark):
    """What the service's own spans look like: a term of two words, one label each."""
    text = spark.createDataFrame([(1, "Stainless Steel coil, stainless-steel; iron")], "query_id int, text string")
    terms = spark.createDataFrame([("material", "stainless steel", 0.92), ("material", "steel", 0.6), ("form", "coil", 0.85), ("end_use", "iron", 0.7), ("material", "iron", 0.8)], "label string, term string, score double")
    got = {(r.label, r.text): (r.start, r.end, r.surface, r.score) for r in entities.dedupe_spans(entities.gazetteer_spans(text, terms)).collect()}
    assert got == {
        ("material", "stainless steel"): (0, 15, "Stainless Steel", 0.92), ("form", "coil"): (16, 20, "coil", 0.85),
        ("material", "iron"): (39, 43, "iron", 0.8), ("end_use", "iron"): (39, 43, "iron", 0.7),
    }
    assert entities.gazetteer_spans(text, terms.where("false")).count() == 0


def test_flatten(spark):
    kept = ['{"material": ["Steel", {"text": "Iron", "start": 0}], "form": [{"start": 1}], "x": []}', "{}", "not json", None, '{"a": ["{no object"]}']
    got = [r.f for r in spark.createDataFrame([(i, k) for i, k in enumerate(kept)], "i int, k string").orderBy("i").select(entities.flatten_entities(F.col("k")).alias("f")).collect()]
    assert got == [{"material": ["Steel", "iron"], "form": [], "x": []}, {}, {}, {}, {"a": ["{no object"]}]
