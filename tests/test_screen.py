"""Entities, embeddings, cover density, and a whole screening."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cargolore.functions.predicates import CONDITIONS
from cargolore.operators import entities, screen, screening
from cargolore.operators.fulltext import cover_density


def test_spans_are_deduped(spark):
    rows = [(1, "material", "Steel", 5, 10, 0.5), (1, "material", "steel", 20, 25, 0.9), (1, "form", "steel", 20, 25, None), (1, "material", "STEEL", 0, 5, 0.9)]
    got = entities.dedupe_spans(spark.createDataFrame(rows, "query_id int, label string, text string, start int, end int, score double")).collect()
    assert {(r.label, r.start) for r in got} == {("material", 0), ("form", 20)}


def test_gazetteer_offsets(spark):
    texts = spark.createDataFrame([(1, "Hot-rolled STEEL, coil of steel"), (2, None)], "query_id int, text string")
    terms = spark.createDataFrame([("material", "steel", 0.9), ("form", "coil", 0.8), ("form", "hot", 0.1)], "label string, term string, score double")
    got = sorted((r.query_id, r.text, r.start, r.end) for r in entities.gazetteer_spans(texts, terms).collect())
    assert got == [(1, "coil", 18, 22), (1, "steel", 11, 16), (1, "steel", 26, 31)]


@pytest.mark.parametrize(("text", "terms", "want"), [("a b a", ["a"], 0.2), ("a x b y a", ["a", "b"], 0.1), ("a x", ["a", "b"], 0.0), ("a b c a c b", ["a", "b", "c"], 0.3), ("a x x a y b", ["a", "b"], 0.05), ("", ["a"], 0.0)])
def test_cover_density(spark, text, terms, want):
    got = spark.range(1).select(cover_density(F.split(F.lit(text), " "), F.array(*(F.lit(t) for t in terms))).alias("x")).first().x
    assert got == pytest.approx(want)


def test_embedding_has_length_one(spark):
    rows = spark.createDataFrame([("steel pipe",), ("",), (None,)], "t string").select(entities.embed(F.col("t"), 32).alias("v")).collect()
    assert [round(sum(x * x for x in r.v), 6) for r in rows] == [1.0, 0.0, 0.0]


def test_routes_of_rules(spark):
    shipments = spark.createDataFrame([(1, "steel", "US", "DE", 10.0, "USD", None), (2, "steel", None, "DE", None, None, None)], "query_id int, text string, origin string, destination string, value double, currency string, metadata map<string,string>")
    rules = [(i, "steel", None, a, b, 0.5, True, "x", c) for i, (a, b, c) in enumerate([(None, None, None), ("US", None, (5.0, None, None, None)), (None, "DE", (50.0, None, None, None)), ("US", "DE", None), ("FR", None, None)])]
    table = spark.createDataFrame(rules, f"rule_id int, phrase string, phrase_group struct<mode:string,phrases:array<string>>, rule_origin string, rule_destination string, threshold double, active boolean, created_by string, conditions struct<{CONDITIONS.replace(' ', ':').replace(',:', ',')}>")
    got = {(r.query_id, r.rule_id): r.conditions_satisfied for r in screening.score_rules(shipments, table).collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 2): False, (1, 3): True, (2, 0): True, (2, 2): False}


def test_screen_gives_every_shipment_one_result(spark):
    shipments = spark.createDataFrame([("1", "steel pipe; copper wire", "US", "DE", 10.0, "USD", None), ("2", "nothing known", None, None, None, None, None)], "query_id string, text string, origin string, destination string, value double, currency string, metadata map<string,string>")
    codes = spark.createDataFrame([("730419", 6, "73", "steel pipe", "steel pipe seamless"), ("741300", 6, "74", "copper wire", "copper wire stranded")], "hs_code string, level int, chapter string, title string, description string")
    goods = spark.createDataFrame([(7, "EU", "r7", "steel pipe", ["730419"], None, None, dt.datetime(2020, 1, 1), None)], "id long, source string, source_record_id string, description string, hs_codes array<string>, valid_from date, valid_to date, sys_from timestamp, sys_to timestamp")
    rules = spark.createDataFrame([(7, None, "DE", "blocked", True)], "id long, rule_origin string, rule_destination string, restriction_type string, active boolean")
    own = spark.createDataFrame([(1, "steel", None, None, None, 0.1, True, "sanctions_source:KW:metals", None)], f"rule_id int, phrase string, phrase_group struct<mode:string,phrases:array<string>>, rule_origin string, rule_destination string, threshold double, active boolean, created_by string, conditions struct<{CONDITIONS.replace(' ', ':').replace(',:', ',')}>")
    terms = spark.createDataFrame([("material", "steel", 0.9), ("material", "copper", 0.9), ("form", "pipe", 0.8)], "label string, term string, score double")
    got = {r.query_id: r for r in screen.screen(shipments, codes, goods, rules, own, terms, on=dt.date(2024, 1, 1), versions=screen.version_stamp()).collect()}
    assert set(got) == {"1", "2"}
    one = got["1"]
    assert {c.hs_code for c in one.hs_classification.top_candidates} == {"730419", "741300"}
    assert [c.hs_code for c in one.hs_classification.multi_commodity] == ["730419", "741300"]
    assert [(m.source, m.hs_code_overlap) for m in one.sanction_matches] == [("EU", ["730419"])]
    assert one.rule_matches_by_list[0].list == "metals"
    assert one.extracted_entities["material"] == ["copper", "steel"]
    assert got["2"].hs_classification.abstain_reason == "no_candidates"
    assert one.versions["engine"] == screen.ENGINE


def test_goods_are_found_without_a_code(spark):
    shipments = spark.createDataFrame([(1, "sealed tube", "US", "DE"), (2, "orchid trading house", "US", "FR"), (3, "tube", "US", "FR"), (4, "tube", "US", "DE")], "query_id int, text string, origin string, destination string")
    codes = spark.createDataFrame([(4, ["730419"])], "query_id int, codes array<string>")
    goods = spark.createDataFrame([(7, "EU", "r7", "sealed tube of steel", ["730419"], "blocked"), (8, "UN", "r8", "brass", ["7403"], "license")], "id long, source string, source_record_id string, description string, hs_codes array<string>, restriction_type string")
    rules = spark.createDataFrame([(7, None, "DE", "blocked", True)], "id long, rule_origin string, rule_destination string, restriction_type string, active boolean")
    aliases = spark.createDataFrame([(8, "Orchid Trading House")], "id long, alias string")
    got = {r.query_id: r.sanction_matches for r in screen.sanction_matches(shipments, codes, goods, rules, aliases).collect()}
    assert {k: [(m.source_record_id, m.hs_code_overlap, m.restriction_type, m.n_rules) for m in v] for k, v in got.items()} == {
        1: [("r7", [], "blocked", 0)], 2: [("r8", [], "license", 0)], 4: [("r7", ["730419"], "blocked", 1)],
    }
    one, two, four = got[1][0].score_components, got[2][0].score_components, got[4][0].score_components
    assert one.dense > 0.5 and one.sparse == 1.0 and not one.structured_match
    assert two.alias_trigram == 1.0 and two.dense == 0.0
    assert four.structured_match and four.rrf_score == pytest.approx(4 / 61, abs=1e-6)
