"""Models as columns: loads a worker, prefixes, and a whole screening with models."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolore.functions.models import Model, Registry, embedder, pair_scorer
from cargolore.functions.predicates import CONDITIONS
from cargolore.functions.scores import lexical_logit
from cargolore.operators import screen, screening

SHIPMENT = "query_id string, text string, origin string, destination string, value double, currency string, metadata map<string,string>"
RULE = f"rule_id int, phrase string, phrase_group struct<mode:string,phrases:array<string>>, rule_origin string, rule_destination string, threshold double, active boolean, created_by string, conditions struct<{CONDITIONS.replace(' ', ':').replace(',:', ',')}>"


def letters(path):
    """A small model: counts of letters; each load writes a file."""

    def load():
        import os
        import uuid

        class Small:
            def encode(self, texts):
                return np.array([[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz:"] for t in texts])

            def score(self, pairs):
                return [4.0 * len(set(a.split()) & set(b.split())) - 2 for a, b in pairs]

        open(f"{path}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return Small()

    return load


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    model = Model("letters", "1", letters(str(tmp_path)), query_prefix="q:")
    texts = spark.range(0, 4000, 1, 40).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    for _ in range(2):
        assert texts.select(embedder(model)(F.col("t")).alias("v")).where("abs(aggregate(v, 0D, (a, x) -> a + x * x) - 1) < 1e-9").count() == 4000
    loads = [p.name.split("-")[1] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) < 40
    again = Model("letters", "2", letters(str(tmp_path)))
    texts.select(embedder(again)(F.col("t")).alias("v")).count()
    texts.select(embedder(again)(F.col("t")).alias("v")).collect()
    assert len(list(tmp_path.iterdir())) > len(loads)


def test_prefix_and_odd_texts(spark, tmp_path):
    model = Model("letters", "1b", letters(str(tmp_path)), query_prefix=":")
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, " ")], "i int, t string").select("i", embedder(model, query=True)(F.col("t")).alias("q"), embedder(model)(F.col("t")).alias("v")).collect()
    got = {r.i: r for r in rows}
    assert got[1].q[26] == pytest.approx(0.5**0.5) and got[1].v[26] == 0 and got[1].v[0] == 1
    assert not any(got[2].q) and not any(got[3].v) and len(got[2].v) == 27


def test_registry():
    models = Registry(Model("a", "1", dict), Model("b", "7", dict))
    models.add(Model("a", "2", dict))
    assert models.versions() == {"model.a": "2", "model.b": "7"} and models["a"].version == "2"
    with pytest.raises(KeyError):
        models["c"]


def test_rules_by_any_scorer_agree(spark, tmp_path):
    shipments = spark.createDataFrame([("1", "steel pipe", "US", "DE", None, None, None), ("2", None, "US", "DE", None, None, None)], SHIPMENT)
    rules = spark.createDataFrame([(1, "steel", None, None, None, 0.1, True, "x", None), (2, "x", ("all_of", ["pipe of steel", "pipe"]), None, "DE", 0.1, True, "x", None), (3, "y", ("any_of", ["wire", "pipe", "pipe"]), "US", None, 0.1, True, "x", None)], RULE)
    plain = lambda q, p: lexical_logit(q, p)
    kept = ("query_id", "rule_id", "mode", "phrase_similarity", "pos")
    one, two = (sorted(map(tuple, screening.score_rules(shipments, rules, s).select(*kept).collect())) for s in (lexical_logit, plain))
    assert one == two and len(one) == 6 and [r[4] for r in one if r[0] == "1"] and sorted(r[4] for r in one) == [0, 0, 1, 1, 2, 2]

    scorer = pair_scorer(Model("letters", "3", letters(str(tmp_path))))
    got = {(r.query_id, r.rule_id): r.per_phrase for r in screening.score_rules(shipments, rules, scorer).collect()}
    high, low = round(1 / (1 + np.exp(-2.0)), 6), round(1 / (1 + np.exp(2.0)), 6)
    assert got == {("1", 1): [high], ("1", 2): [round(1 / (1 + np.exp(-6.0)), 6), high], ("1", 3): [low, high, high], ("2", 1): [low], ("2", 2): [low, low], ("2", 3): [low, low, low]}


def test_a_whole_screening_with_models(spark, tmp_path):
    models = Registry(Model("embed", "e1", letters(str(tmp_path)), query_prefix=":"), Model("pairs", "p1", letters(str(tmp_path))))
    shipments = spark.createDataFrame([("1", "steel pipe", "US", "DE", 10.0, "USD", None), ("2", "zzz", "US", "DE", None, None, None)], SHIPMENT)
    codes = spark.createDataFrame([("730419", 6, "73", "steel pipe", "steel pipe seamless"), ("741300", 6, "74", "copper wire", "copper wire stranded")], "hs_code string, level int, chapter string, title string, description string")
    goods = spark.createDataFrame([(7, "EU", "r7", "tube of metal", ["999999"], None, None, dt.datetime(2020, 1, 1), None)], "id long, source string, source_record_id string, description string, hs_codes array<string>, valid_from date, valid_to date, sys_from timestamp, sys_to timestamp")
    routes = spark.createDataFrame([(7, None, "DE", "blocked", True)], "id long, rule_origin string, rule_destination string, restriction_type string, active boolean")
    own = spark.createDataFrame([(1, "steel", None, None, None, 0.1, True, "x", None)], RULE)
    terms = spark.createDataFrame([("material", "steel", 0.9)], "label string, term string, score double")
    aliases = spark.createDataFrame([(7, "steel pipe works")], "id long, alias string")
    examples = spark.createDataFrame([(1, "741300", "zzz cables")], "example_id long, hs_code string, text string")
    got = {r.query_id: r for r in screen.screen(
        shipments, codes, goods, routes, own, terms, on=dt.date(2024, 1, 1), versions=screen.version_stamp(**models.versions()), scorer=pair_scorer(models["pairs"]), aliases=aliases,
        embed=embedder(models["embed"]), embed_query=embedder(models["embed"], query=True), dense=True, examples=examples,
    ).collect()}
    one = got["1"]
    assert {c.hs_code for c in one.hs_classification.top_candidates} == {"730419", "741300"}  # the second by its vector only
    assert one.hs_classification.top_candidates[0].score_components.dense > 0.5
    assert got["2"].hs_classification.top_candidates[0].hs_code == "741300"  # by an example
    assert one.sanction_matches[0].source_record_id == "r7" and one.sanction_matches[0].score_components.alias_trigram > 0.45
    assert one.rule_matches[0].phrase_similarity == pytest.approx(1 / (1 + np.exp(-2.0)), abs=1e-4)
    assert one.versions["model.embed"] == "e1" and one.versions["model.pairs"] == "p1"
