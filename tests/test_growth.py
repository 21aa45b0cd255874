"""Queries whose work is bounded by what differs, not by pairs of equal rows."""

import datetime as dt
import math
import pickle
import random

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_queries import plain

import __spark_entry__ as contract
from cargolore.functions.predicates import CONDITIONS
from cargolore.operators import entities, evaluation, fulltext, retrieval, screen, screening, temporal, vectors
from cargolore.sources import reference, sinks


def most_rows(spark, df):
    """The rows of ``df``, and the most that any step of its plan gave out."""
    rows = df.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    run = store.executionsList().last().executionId()
    values, nodes, most = store.executionMetrics(run), store.planGraph(run).allNodes(), 0
    for i in range(nodes.size()):
        for j in range(nodes.apply(i).metrics().size()):
            metric = nodes.apply(i).metrics().apply(j)
            if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return rows, most


def test_upsert_codes_keeps_lines_of_one_code(spark, tmp_path):
    """Numbers 716,539 apart have the same code (97 * 89 * 83)."""
    keys = [0, 1, 2, 3, 716539, 716540, 716541, 716542]
    part = {"p_partkey": keys, "p_name": [f"name {k}" for k in keys], "p_type": ["T"] * 8, "p_brand": ["B"] * 8, "p_size": [1] * 8, "p_retailprice": [1.0] * 8}
    pq.write_table(pa.table(part), tmp_path / "part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got, want = contract.queries()["upsert_codes"](spark, str(tmp_path)).toPandas(), con.sql(contract.oracle_sql()["upsert_codes"]).df()
    assert plain(got) == plain(want)


def test_entity_topk_meets_equal_sets_once(spark):
    """300 queries of the same pairs, 300 codes of the same; weights whose sums differ by order are ties."""
    asked = spark.createDataFrame([(q, t, "x") for q in range(300) for t in ("a", "b", "c")], "query_id int, entity_type string, entity_value string")
    index = [(f"{c:06d}", t, "x", w) for c in range(300) for t, w in zip("abc", (0.1, 0.2, 0.3) if c % 2 else (0.3, 0.2, 0.1), strict=True)]
    codes = spark.createDataFrame(index, "hs_code string, entity_type string, entity_value string, weight double")
    rows, most = most_rows(spark, retrieval.entity_topk(asked, codes, 4))
    assert {(r.query_id, r.hs_code, r.pos) for r in rows} == {(q, f"{c:06d}", c) for q in range(300) for c in range(4)}
    assert most < 3000  # 90,000 pairs of a query and a code


def test_prefix_expansion_has_no_row_a_pair(spark):
    codes = spark.range(300).selectExpr("id", "array('01', '0101', '99', '01') AS hs_codes")
    tree = spark.range(300).selectExpr("lpad(CAST(10000 + id AS STRING), 6, '0') AS hs_code", "6 AS level")
    rows, most = most_rows(spark, temporal.expand_prefixes(codes, tree))
    assert {(r.id, tuple(r.hs_codes)) for r in rows} == {(i, tuple(f"{10000 + c:06d}" for c in range(300))) for i in range(300)}
    assert most < 3000  # 90,000 pairs of an id and a code


def test_feedback_to_gold_meets_equal_texts_once(spark):
    feedback = spark.range(300).selectExpr("7L AS result_id", "'override' AS kind", "CAST(id % 2 AS STRING) AS corrected_code")
    results = spark.createDataFrame([(7, 70)], "result_id long, query_id long")
    shipments = spark.range(300).selectExpr("70L AS query_id", "concat('text ', id % 3) AS text")
    rows, most = most_rows(spark, sinks.feedback_to_gold(feedback, results, shipments))
    assert {(r.description, r.hs_code) for r in rows} == {(f"text {t}", str(c)) for t in range(3) for c in range(2)} and len(rows) == 6
    assert most < 1000  # 90,000 pairs of a correction and a text


def test_sparse_topk_meets_equal_texts_once(spark):
    """300 queries of two texts, 300 documents of three: ties go to the lesser key."""
    asked = spark.range(300).selectExpr("id AS query_id", "CASE id % 2 WHEN 0 THEN 'red box' ELSE 'box' END AS text")
    docs = spark.range(300).selectExpr("id AS hs_code", "CASE id % 3 WHEN 0 THEN 'a red box' WHEN 1 THEN 'red steel box' ELSE 'blue box' END AS text")
    rows, most = most_rows(spark, retrieval.sparse_topk(asked, fulltext.indexed(docs), 4))
    wanted = {0: [0, 3, 6, 9], 1: [0, 1, 2, 3]}
    assert {(r.query_id, r.hs_code, r.pos) for r in rows} == {(q, c, i) for q in range(300) for i, c in enumerate(wanted[q % 2])}
    assert most < 3000  # 75,000 pairs of a query and a document


def test_rulings_of_a_small_file_are_parsed_in_all_tasks(spark):
    pages = spark.range(0, 400, 1, 1).selectExpr("id AS page_id", "concat('<h2>Goods</h2><p>box ', id, '</p><p>1234.56</p>') AS html")
    found = reference.read_rulings(pages)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.page_id, r.hs_code) for r in found.collect()} == {(i, "123456") for i in range(400)}


def test_spans_of_equal_texts_are_found_once(spark):
    texts = spark.range(300).selectExpr("id AS query_id", "CASE id % 2 WHEN 0 THEN 'red box, red box' ELSE 'box' END AS text")
    terms = spark.createDataFrame([("form", "box", 0.9), ("form", "red box", 0.8)], "label string, term string, score double")
    found = entities.distinct_spans(texts, terms)
    assert {(r.query_id, r.text, r.start) for r in found.collect()} == {(i, *(("box", 0) if i % 2 else ("red box", 0))) for i in range(300)}
    rows, most = most_rows(spark, found.where("text = 'box'"))
    assert len(rows) == 150 and most <= 300


def test_ranker_learns_equal_rows_once(spark, monkeypatch):
    seen = []

    class Kept:
        def __init__(self, **_):
            pass

        def fit(self, table):
            seen.append(table)

    monkeypatch.setattr(evaluation, "GBTClassifier", Kept)
    rows = spark.range(300).selectExpr("CAST(id % 3 AS DOUBLE) AS f", "CAST(id % 3 + 2 AS INT) AS grade")
    evaluation.train_ranker(rows, ["f"])
    assert sorted((r.features[0], r.label, r.weight) for r in seen[0].collect()) == [(0.0, 0.0, 100.0), (1.0, 1.0, 100.0), (2.0, 1.0, 100.0)]


def test_automaton_reaches_workers_without_the_package(spark, monkeypatch):
    sent = []
    whole = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or whole(self, value))
    texts = spark.createDataFrame([(1, "a red box"), (2, "box")], "query_id int, text string")
    terms = spark.createDataFrame([("form", "box", 0.9), ("form", "red box", 0.8)], "label string, term string, score double")
    assert {(r.query_id, r.text) for r in entities.gazetteer_spans(texts, terms).collect()} == {(1, "red box"), (2, "box")}
    assert len(sent) == 1 and b"cargolore" not in sent[0]


def test_screen_finds_sanctions_once_for_equal_texts_and_routes(spark, monkeypatch):
    seen = []
    found = screen.sanction_matches
    monkeypatch.setattr(screen, "sanction_matches", lambda shipments, codes, *rest: seen.append((shipments.count(), codes.count())) or found(shipments, codes, *rest))
    shipments = spark.range(60).selectExpr("id AS query_id", "CASE id % 3 WHEN 0 THEN 'steel pipe' WHEN 1 THEN 'wire' END AS text", "IF(id % 2 = 0, 'US', NULL) AS origin", "'DE' AS destination", "1D AS value", "'USD' AS currency", "CAST(NULL AS map<string,string>) AS metadata")
    codes = spark.createDataFrame([("730419", 6, "73", "steel pipe", "steel pipe seamless")], "hs_code string, level int, chapter string, title string, description string")
    goods = spark.createDataFrame([(7, "EU", "r7", "steel pipe", ["730419"], None, None, dt.datetime(2020, 1, 1), None)], "id long, source string, source_record_id string, description string, hs_codes array<string>, valid_from date, valid_to date, sys_from timestamp, sys_to timestamp")
    rules = spark.createDataFrame([(7, "US", None, "blocked", True)], "id long, rule_origin string, rule_destination string, restriction_type string, active boolean")
    own = spark.createDataFrame([], f"rule_id int, phrase string, phrase_group struct<mode:string,phrases:array<string>>, rule_origin string, rule_destination string, threshold double, active boolean, created_by string, conditions struct<{CONDITIONS.replace(' ', ':').replace(',:', ',')}>")
    terms = spark.createDataFrame([("material", "steel", 0.9)], "label string, term string, score double")
    got = screen.screen(shipments, codes, goods, rules, own, terms, on=dt.date(2024, 1, 1), versions=screen.version_stamp()).collect()
    assert sorted(r.query_id for r in got) == list(range(60))
    assert {r.query_id for r in got if r.sanction_matches} == {i for i in range(60) if i % 2 == 0 and i % 3 < 2}  # vectors find the nearest, however far
    assert {r.query_id for r in got if r.hs_classification.top_candidates} == {i for i in range(60) if i % 3 == 0}
    assert seen == [(6, 2)]


def test_confidence_reads_candidates_once(spark):
    rows = spark.range(12).selectExpr(
        "id DIV 4 AS query_id", "id % 4 AS place", "concat('0', id % 4, '01') AS hs_code", "IF(id >= 8, NULL, concat('0', id % 2)) AS chapter", "(4 - id % 4) / 10D AS score",
        "named_struct('dense', 0.5D, 'sparse', 0.1D, 'cross_encoder', 0.5D) AS score_components",
    )
    out = retrieval.confidence(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1  # two before, one of them for chapters
    got = {r.query_id: r for r in out.collect()}
    assert set(got) == {0, 1, 2}
    for q in (0, 1):
        assert (got[q].top1_score, got[q].top1_minus_top2, got[q].top_code, got[q].cross_source_agreement) == (0.4, 0.1, "0001", True)
        assert got[q].entropy_topk == 1.2799 and got[q].chapter_consensus == 0.6 and got[q].chapter_distribution == {"00": 0.6, "01": 0.4}
    assert got[2].chapter_consensus == 0.0 and got[2].chapter_distribution is None and got[2].entropy_topk == 1.2799


def test_merged_paths_stay_dealt_by_query(spark):
    """Small partitions are not put together: sorts and sums of a query take more memory than is shuffled."""
    one = spark.range(300).selectExpr("id DIV 30 AS query_id", "id % 30 AS id", "id % 7 / 7D AS similarity")
    goods = spark.range(30).selectExpr("id", "concat('good ', id) AS description")
    queries = spark.range(10).selectExpr("id AS query_id", "'good' AS text")
    got = screening.merge_matches({"structured": one.where("id < 3").select("query_id", "id"), "dense": one}, goods, queries)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = got.collect()
    assert len(rows) == 300 and {r.query_id for r in rows if r.pos == 0 and r.structured_match} == set(range(10))
    # one for all paths, one for the queries
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning(query_id") <= 2


def test_vectors_of_goods_are_not_broadcast(spark):
    """Each different description is embedded once, and no join sends vectors to all executors."""
    goods = spark.range(400).selectExpr("id", "concat('steel box ', id % 4) AS description")
    rules = spark.range(400).selectExpr("id", "'US' AS rule_origin", "CAST(NULL AS STRING) AS rule_destination", "id % 2 = 0 AS active")
    asked = spark.createDataFrame([(1, "steel box 2", "US", "DE"), (2, "steel box 2", "FR", "DE")], "query_id int, text string, origin string, destination string")
    made, kept, plain_rows = spark.sparkContext.accumulator(0), [], vectors._rows

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        made.add(len(texts))
        return texts.map(lambda t: [float(ord(t[-1]) - 47), 1.0])

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vectors, "_rows", lambda df, vector, keys: (kept.append(df), plain_rows(df, vector, keys))[1])
        shipped = asked.withColumn("q", embed(F.col("text")))
        got = screening.dense_matches(shipped, goods, rules, 3, embed).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(1, 2), (1, 6), (1, 10)]
    assert made.value <= 2 * 2 + 4  # 400 goods; a shipment's vector is also asked for by a filter
    assert "Broadcast" not in kept[0]._jdf.queryExecution().executedPlan().toString()


def test_equal_descriptions_are_searched_once(spark):
    goods = spark.range(300).selectExpr("id", "concat('red box', repeat(' x', CAST(id % 3 AS INT))) AS description").unionByName(spark.createDataFrame([(None, "red box"), (900, None)], "id long, description string"))
    rules = spark.range(300).selectExpr("id", "CAST(NULL AS STRING) AS rule_origin", "CAST(NULL AS STRING) AS rule_destination", "id >= 6 AS active")
    asked = spark.createDataFrame([(1, "box", "US", "DE"), (2, "x red", None, None), (3, "", "US", "DE")], "query_id int, text string, origin string, destination string")
    found, searched = fulltext.matches, []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fulltext, "matches", lambda q, index, *more: (searched.append(index.count()), found(q, index, *more))[1])
        got = screening.sparse_matches(asked, goods, rules, 4).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(1, 6), (1, 7), (1, 8), (1, 9), (2, 7), (2, 8), (2, 10), (2, 11)]
    assert searched[0] <= 4  # 300 goods


def test_entity_topk_makes_no_row_a_pair_of_sets(spark, monkeypatch):
    """All sets differ and share one frequent pair; tiles of any size give the same as all pairs compared."""
    r = random.Random(5)
    asked = {q: {("brand", "x"), ("name", str(r.randrange(12))), ("form", str(q % 9))} for q in range(108)} | {900: {("none", "x")}}
    index = [(f"{c:06d}", t, v, w) for c in range(900) for t, v, w in [("brand", "x", 0.1), ("name", str(c % 12), r.choice([0.2, 0.7, 0.0])), ("form", str(c % 7), 0.3), ("form", str(c % 7), 0.1 * (c % 3)), ("own", str(c), 1.0)]]
    index += [("000950", "none", "x", None), ("000951", "none", "x", -1.0), ("000952", "none", "x", 0.0), ("000953", "no", "nex", 9.0), ("000954", "none", "x", 0.5)]
    queries = spark.createDataFrame([(q, *p) for q, own in asked.items() for p in own], "query_id int, entity_type string, entity_value string")
    codes = spark.createDataFrame(index, "hs_code string, entity_type string, entity_value string, weight double")
    want = set()
    for q, own in asked.items():
        total = {}
        for c, t, v, w in index:
            if (t, v) in own:
                total[c] = total.get(c, 0.0) + w if w is not None else total.get(c, -math.inf)
        best = sorted(total, key=lambda c: (-round(total[c], 9), c))[:5]
        want |= {(q, c, i, None if total[c] == -math.inf else round(total[c], 6)) for i, c in enumerate(best)}
    for sizes in ((32_768, 4096), (100, 30)):
        monkeypatch.setattr(retrieval, "TILE_CODES", sizes[0])
        monkeypatch.setattr(retrieval, "TILE_QUERIES", sizes[1])
        rows, most = most_rows(spark, retrieval.entity_topk(queries, codes, 5))
        assert {(x.query_id, x.hs_code, x.pos, None if x.weight is None else round(x.weight, 6)) for x in rows} == want
        assert most < 20_000  # 97,200 pairs of sets that share the brand
