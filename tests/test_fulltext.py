"""Stems, text configurations, cover density and alias likeness against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from cargolore.functions.stemming import lexemes, stem
from cargolore.operators import fulltext, screening

# Words and the stems that the published rules give them.
STEMS = """caresses caress ponies poni ties tie cats cat gas gas running run hopping hop hoping hope relational relat conditional condit generously generous
happy happi cry cri by by national nation economy economi large larg troubled troubl feed feed agreed agre machinery machineri containing contain plastered plaster
motoring motor sized size falling fall hissing hiss fizzed fizz failing fail filing file consignment consign consistency consist consolatory consolatori
conspirator conspir knackeries knackeri knightly knight hopefulness hope goodness good adjustment adjust adoption adopt communication communic communism communism
electricity electr luxuriated luxuri triplicate triplic formative format probate probat rate rate roll roll enjoy enjoy youth youth batteries batteri alloys alloy
plated plate manufacturing manufactur valves valv apology apolog possibly possibl skies sky dying die news news inning inning proceed proceed""".split()


def test_stems():
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    assert [(w, stem(w)) for w, _ in pairs] == pairs
    assert stem("größen") == "größen" and stem("x12s") == "x12s" and stem("") == ""


def test_configurations(spark):
    rows = spark.createDataFrame([("The Pipes OF Größe-12, and valves",), (None,), ("",)], "t string")
    got = rows.select(lexemes(F.col("t")).alias("e"), lexemes(F.col("t"), "simple").alias("s")).collect()
    assert got[0].e == ["", "pipe", "", "größe", "12", "", "valv"]
    assert got[0].s == ["the", "pipes", "of", "größe", "12", "and", "valves"]
    assert got[1].e == got[1].s == got[2].s == []
    with pytest.raises(ValueError):
        lexemes(F.col("t"), "latin")


def plain_density(words, terms):
    runs = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if set(terms) <= set(words[a : b + 1])]
    least = [(a, b) for a, b in runs if not any(a <= c and d <= b and (c, d) != (a, b) for c, d in runs)]
    return sum(0.1 / (1 + sum(w not in terms for w in words[a : b + 1])) for a, b in least)


def test_cover_density_of_random_texts(spark):
    r = random.Random(6)
    rows = []
    for _ in range(300):
        terms = r.sample("abcd", r.randrange(1, 5))
        rows.append(([r.choice("abcdxy") for _ in range(r.randrange(14))], terms))
    got = spark.createDataFrame(rows, "w array<string>, t array<string>").select("w", "t", fulltext.cover_density(F.col("w"), F.col("t")).alias("d")).collect()
    assert all(x.d == pytest.approx(plain_density(x.w, x.t)) for x in got)


def test_search_against_a_plain_version(spark):
    r = random.Random(8)
    vocabulary = ["pipe", "pipes", "steel", "the", "of", "valve", "rare", "größe"]
    docs = [(i if i else None, " ".join(r.choice(vocabulary[: 6 + i % 3]) for _ in range(r.randrange(12)))) for i in range(60)]
    queries = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(4)))) for i in range(40)] + [(99, None), (100, "unknown pipe")]
    for config in ("english", "simple"):
        def cut(text):
            return ["" if config == "english" and w in ("the", "of") else stem(w) if config == "english" else w for w in (text or "").split()]

        want = {}
        for q, text in queries:
            terms = list({w for w in cut(text) if w})
            for d, body in docs:
                if d and terms and set(terms) <= set(cut(body)):
                    want[q, d] = round(plain_density(cut(body), terms), 6)
        index = fulltext.indexed(spark.createDataFrame(docs, "hs_code int, text string"), config=config)
        found = fulltext.matches(spark.createDataFrame(queries, "query_id int, text string"), index, config=config)
        assert {(x.query_id, x.hs_code): round(x["rank"], 6) for x in found.collect()} == want


def grams(text):
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


@pytest.mark.parametrize("floor", [0.2, 0.45, 0.8, 1.0])
def test_aliases_against_all_pairs(spark, floor):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 5)))
    names = [(i, " ".join(word() for _ in range(r.randrange(4))) + " Trading House") for i in range(60)] + [(5, "x"), (61, None), (62, "abcd")]
    aliases = [(i % 40, " ".join(word() for _ in range(r.randrange(3))) + " Trade House") for i in range(80)] + [(7, None), (8, ""), (9, names[3][1]), (9, names[3][1])]
    got = screening.alias_matches(spark.createDataFrame(names, "query_id int, name string"), spark.createDataFrame(aliases, "id int, alias string"), floor)
    want = {}
    for q, name in names:
        if name and len(name.split()) > 1:
            for i, alias in aliases:
                a, b = grams(name), grams(alias or "")
                like = len(a & b) / len(a | b)
                if like >= floor:
                    want[q, i] = max(want.get((q, i), 0), round(like, 9))
    assert {(x.query_id, x.id): round(x.similarity, 9) for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("often", [1, 1024])
def test_aliases_are_final_in_their_tile(spark, monkeypatch, often):
    """Many names of a query, cut by strips, and many aliases of a good; nothing is shuffled after the tiles."""
    for name, value in (("TILE_TEXTS", 16), ("STRIP_NAMES", 3), ("OFTEN_PAIRS", often)):
        monkeypatch.setattr(screening, name, value)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 4)))
    names = [(None if i % 9 == 8 else i % 9, f"{word()} {word()} {word()}") for i in range(90)] + [(i, f"{word()} {word()} x") for i in range(10, 30)] + [(5, "??? !!!")]
    aliases = [(f"g{i % 7}", f"{word()} {word()}") for i in range(60)] + [("none", "?"), (None, "ab abc")]
    got = screening.alias_matches(spark.createDataFrame(names, "query_id int, name string"), spark.createDataFrame(aliases, "id string, alias string"), 0.3)
    want = {}
    for q, name in names:
        for i, alias in aliases:
            a, b = grams(name), grams(alias)
            if len("".join(name.split())) >= 4 and a and b and (like := len(a & b) / len(a | b)) >= 0.3:
                want[q, i] = max(want.get((q, i), 0), like)
    rows = got.collect()
    assert {(x.query_id, x.id): x.similarity for x in rows} == want and len(rows) == len(want) > 100
    above, tile, _ = got._jdf.queryExecution().optimizedPlan().toString().partition("FlatMapGroupsInArrow")
    assert tile and "Aggregate" not in above and "Join" not in above
