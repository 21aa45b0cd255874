"""Retrieval, screening, temporal and evaluation operators on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cargolore.operators import dashboards, evaluation, retrieval, screening, temporal

C = "query_id int, hs_code string, pos int"


def test_rrf(spark):
    dense = spark.createDataFrame([(1, "854231", 0, 0.9), (1, "854232", 1, 0.8)], C + ", dense_similarity double")
    sparse = spark.createDataFrame([(1, "854231", 0, 0.5)], C + ", sparse_score double")
    got = {r.hs_code: r for r in retrieval.union({"dense": dense, "sparse": sparse}).collect()}
    assert got["854231"].rrf_score == pytest.approx(2 / 61)
    assert got["854232"].rrf_score == pytest.approx(1 / 62)
    scaled = retrieval.union({"dense": dense.withColumn("dense_similarity", F.col("dense_similarity") * 1000), "sparse": sparse})
    assert {r.hs_code: r.rrf_score for r in scaled.collect()} == {k: r.rrf_score for k, r in got.items()}


def test_abstention(spark):
    rows = [(1, 0.30, 0.05, 0.6), (2, 0.30, 0.05, 0.1), (3, 0.55, 0.01, 0.2), (4, 0.90, 0.60, 0.7)]
    conf = spark.createDataFrame([(*r, "720839") for r in rows], "query_id int, top1_score double, top1_minus_top2 double, chapter_consensus double, top_code string")
    got = {r.query_id: (r.abstained, r.abstain_reason, r.fallback_level, r.fallback_code) for r in retrieval.abstention(spark.range(5).select(F.col("id").cast("int").alias("query_id")), conf).collect()}
    assert got == {
        0: (True, "no_candidates", None, None), 1: (True, "low_top1", 4, "7208"), 2: (True, "low_top1", 2, "72"),
        3: (True, "ambiguous_chapter", 2, "72"), 4: (False, None, None, None),
    }


def test_fallback_is_clamped(spark):
    got = spark.createDataFrame([("7208", 6), ("720", 2), ("720", 4)], "c string, n int").select(retrieval.fallback_code(F.col("c"), F.col("n")).alias("x"))
    assert [r.x for r in got.collect()] == ["7208", "72", None]


def test_dense_leaves_zero_vectors_out(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0])], "hs_code string, v array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q array<double>")
    assert [r.hs_code for r in retrieval.dense_topk(queries, corpus, 5).orderBy("pos").collect()] == ["a", "c"]


def test_rule_grouping(spark):
    rows = [(1, i, p, s, 0.5, ok, c) for i, (p, s, ok, c) in enumerate([("tuna", 0.8, True, "sanctions_source:KW:seafood"), ("cod", 0.6, True, "sanctions_source:KW:seafood"), ("acid", 0.4, True, "sanctions_source:KW:chemicals"), ("x", 0.9, True, "sanctions_source:EU"), ("y", 0.9, True, None)])]
    got = screening.group_by_list(spark.createDataFrame(rows, "query_id int, rule_id int, phrase string, phrase_similarity double, threshold double, conditions_satisfied boolean, created_by string"))
    assert {r.list: (r.n_total, r.n_above_threshold, r.top_phrase) for r in got.collect()} == {"seafood": (2, 2, "tuna"), "chemicals": (1, 0, "acid")}


def test_modes(spark):
    rules = spark.createDataFrame([("p", ("any_of", ["a", "b"])), ("p", ("all_of", ["a"])), ("p", ("odd", ["a"])), ("p", ("all_of", [])), ("p", None)], "phrase string, phrase_group struct<mode:string,phrases:array<string>>")
    assert [(r.mode, r.all_phrases) for r in screening.phrases_of(rules).collect()] == [("any_of", ["a", "b"]), ("all_of", ["a"]), ("any_of", ["a"]), ("single", ["p"]), ("single", ["p"])]


GOODS = "id long, source string, source_record_id string, description string, hs_codes array<string>, restriction_type string, provenance_url string, valid_from date, valid_to date, sys_from timestamp, sys_to timestamp"


def test_bitemporal_cycle(spark):
    t0, t1, t2 = (dt.datetime(2024, m, 1) for m in (1, 2, 3))
    feed = spark.createDataFrame([("EU", "1", "steel", ["7208", "7209"]), ("EU", "2", "brass", []), ("EU", None, "loose", [])], "source string, source_record_id string, description string, hs_codes array<string>")
    for c, kind in (("restriction_type", "string"), ("provenance_url", "string"), ("valid_from", "date"), ("valid_to", "date")):
        feed = feed.withColumn(c, F.lit(None).cast(kind))
    first = temporal.bitemporal_upsert(feed, spark.createDataFrame([], GOODS), F.lit(t0))
    assert first.count() == 3
    again = feed.withColumn("hs_codes", F.reverse("hs_codes"))  # lists count as sets
    assert temporal.bitemporal_changes(again, first).where("action <> 'keep'").count() == 0
    changed = feed.where("source_record_id = '1'").withColumn("description", F.lit("steel plate"))
    second = temporal.bitemporal_upsert(changed, first, F.lit(t1))
    actions = {r.source_record_id: r.action for r in temporal.bitemporal_changes(changed, first).collect()}
    assert actions == {"1": "update", "2": "close", None: "keep"}
    assert {r.description for r in temporal.as_of(second, F.lit(t2)).collect()} == {"steel plate", "loose"}
    assert {r.description for r in temporal.as_of(second, F.lit(t0)).collect()} == {"steel", "brass", "loose"}
    assert second.where("source_record_id = '1'").select("id").distinct().count() == 1
    assert temporal.bitemporal_changes(feed.limit(0), first).where("action <> 'keep'").count() == 0


def test_upserts_are_null_safe(spark):
    old = spark.createDataFrame([("s", None, "1"), ("s", "b", "2")], "source string, source_id string, hs_code string")
    new = spark.createDataFrame([("s", None, "1"), ("s", "c", "3"), ("s", "c", "3")], "source string, source_id string, hs_code string")
    assert temporal.insert_absent(new, old, ["source", "source_id", "hs_code"]).count() == 3


def test_sweep_and_error(spark):
    good = [(i, x, True) for i, x in enumerate((0.9, 0.85, 0.8, 0.75))] + [(i + 4, x, False) for i, x in enumerate((0.2, 0.25, 0.3, 0.35))]
    records = spark.createDataFrame(good, "id int, score double, correct boolean")
    grid = spark.range(1, 20).select((F.col("id") / 20).alias("threshold"))
    best = evaluation.best_threshold(evaluation.sweep(records, grid), 0.3).first()
    assert best.precision == 1.0
    assert 0.35 < best.threshold <= 0.75
    assert evaluation.best_threshold(evaluation.sweep(records, grid), 0.99).first().coverage >= 0.99
    perfect = records.select("id", F.col("correct").cast("double").alias("prob"), "correct")
    assert evaluation.calibration_error(perfect).first().ece == 0.0


def test_page_bounds(spark):
    with pytest.raises(ValueError, match="limit"):
        dashboards.page(spark.range(1), limit=501)


def test_goods_off_the_route_take_no_place(spark):
    shipments = spark.createDataFrame([(1, "steel", [1.0, 0.0], "US", "DE"), (2, "steel", [1.0, 0.0], None, None)], "query_id int, text string, q array<double>, origin string, destination string")
    goods = spark.createDataFrame([(1, "steel steel steel", [1.0, 0.0]), (2, "steel steel", [1.0, 0.1]), (3, "steel", [1.0, 0.5]), (4, "steel", [1.0, 0.4]), (5, "steel", [1.0, 0.0])], "id long, description string, v array<double>")
    rules = spark.createDataFrame([(1, "FR", None, True), (2, "US", None, False), (3, "US", "DE", True), (3, None, "DE", True), (4, None, None, True)], "id long, rule_origin string, rule_destination string, active boolean")
    for match, nearest in ((screening.dense_matches, 4), (screening.sparse_matches, 3)):
        assert {(r.query_id, r.id) for r in match(shipments, goods, rules, 1).collect()} == {(1, nearest), (2, 4)}
        assert {(r.query_id, r.id) for r in match(shipments, goods, rules, 2).collect()} == {(1, 3), (1, 4), (2, 4)}


GOODS = "id long, source string, source_record_id string, description string, hs_codes array<string>, restriction_type string, provenance_url string, valid_from date, valid_to date, sys_from timestamp, sys_to timestamp"


def test_rows_without_record_id_are_kept(spark):
    at, later = dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)
    table = spark.createDataFrame([], GOODS)
    feed = spark.createDataFrame([("EU", None, d, ["1"], None, None, None, None) for d in ("a", "b", "b", "c")] + [("EU", "r", "d", ["1"], None, None, None, None)], ", ".join(GOODS.split(", ")[1:9]))
    first = temporal.bitemporal_upsert(feed, table, F.lit(at))
    assert sorted(r.description for r in first.collect()) == ["a", "b", "c", "d"]
    assert first.select("id").distinct().count() == 4
    again = temporal.bitemporal_upsert(feed.where("description <> 'a'"), first, F.lit(later))
    assert sorted((r.description, r.sys_to is None) for r in again.collect()) == [("a", True), ("b", True), ("c", True), ("d", True)]


def test_last_writer_wins_and_first_is_kept(spark):
    new = spark.createDataFrame([("k", "old", 1), ("k", "new", 2), (None, "x", 1), (None, "y", 3)], "k string, v string, n int")
    none = new.limit(0)
    assert {r.k: r.v for r in temporal.upsert(new, none, ["k"], order="n").collect()} == {"k": "new", None: "y"}
    assert {r.k: r.v for r in temporal.insert_absent(new, none, ["k"], order="n").collect()} == {"k": "old", None: "x"}


def test_rules_carry_conditions(spark):
    goods = spark.createDataFrame([(1, "EU", "a", "pipes, tubes and rods", None), (2, "EU", "b", " ", None), (3, "EU", None, "wire", None)], "id long, source string, source_record_id string, description string, sys_to timestamp")
    rules = spark.createDataFrame([(1, "US", None, True, '{"min_value": 5}'), (1, "US", None, True, None), (1, None, "DE", False, None)], "id long, rule_origin string, rule_destination string, active boolean, conditions string")
    config = spark.createDataFrame([("EU", True, 0.5, "something new")], "source string, enabled boolean, default_threshold double, phrase_strategy string")
    aliases = spark.createDataFrame([(1, "conduit")], "id long, alias string")
    got = {r.id: r for r in temporal.materialized_rules(goods, rules, aliases, config).collect()}
    assert set(got) == {1, 3}
    assert got[1].conditions == '{"min_value": 5}' and got[1].phrases == ["pipes, tubes and rods", "pipes", "tubes", "rods", "conduit"]
    assert got[3].conditions is None and (got[3].rule_origin, got[3].rule_destination) == (None, None)


def test_cutover(spark):
    goods = spark.createDataFrame([(1, "a", [1.0], None, None), (2, "b", [2.0], [9.0], None)], "id int, description string, embedding array<double>, v2 array<double>, sys_to timestamp")
    with pytest.raises(ValueError, match="1 of 2"):
        temporal.cut_over(goods, "v2")
    filled = temporal.backfill(goods, "v2", F.array(F.length("description").cast("double")))
    live = temporal.cut_over(filled, "v2")
    assert [r.embedding for r in live.orderBy("id").collect()] == [[1.0], [9.0]]
    back = temporal.roll_back(live, "v2")
    assert [(r.embedding, r.v2) for r in back.orderBy("id").collect()] == [([1.0], [1.0]), ([2.0], [9.0])]


def test_shared_keys_bound_the_search(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0], ["x"]), ("b", [0.9, 0.1], ["y", "z"]), ("c", [0.5, 0.5], None), ("d", [0.8, 0.1], ["x"]), ("e", [1.0], ["x"])], "hs_code string, v array<double>, on array<string>")
    queries = spark.createDataFrame([(1, [1.0, 0.0], ["z", "q"]), (2, [1.0, 0.0], ["x", "y"]), (3, [1.0, 0.0], []), (4, None, ["x"])], "query_id int, q array<double>, of array<string>")
    got = [(r.query_id, r.hs_code) for r in retrieval.dense_topk(queries, corpus, 2, among=("of", "on")).orderBy("query_id", "pos").collect()]
    assert got == [(1, "b"), (2, "a"), (2, "b")] or got == [(1, "b"), (2, "a"), (2, "d")]


def test_isotonic_against_pooling(spark):
    import random

    r = random.Random(3)
    rows = [(i, round(r.random(), 2), r.random() < 0.4) for i in range(200)]
    got = {x.id: x.probability for x in evaluation.isotonic(spark.createDataFrame(rows, "id int, score double, correct boolean")).collect()}
    blocks = []
    for score in sorted({s for _, s, _ in rows}):
        own = [float(c) for _, s, c in rows if s == score]
        blocks.append([sum(own), len(own), [score]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            total, n, scores = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + n, blocks[-1][2] + scores]
    want = {s: total / n for total, n, scores in blocks for s in scores}
    assert all(got[i] == pytest.approx(want[s], abs=1e-9) for i, s, _ in rows)


def test_latency_of_few_rows(spark):
    one = evaluation.latency(spark.createDataFrame([(5.0,), (None,)], "latency_ms double")).first()
    assert (one.p50, one.p99, one.mean, one.n) == (5.0, 5.0, 5.0, 1)
    none = evaluation.latency(spark.createDataFrame([], "latency_ms double")).first()
    assert (none.p50, none.mean, none.n) == (None, None, 0)
