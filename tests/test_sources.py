"""Readers and writers on small files, and the streaming jobs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cargolore.sources import reference, sinks
from cargolore.streaming import screen


def test_schedule_headers_and_mark(spark, tmp_path):
    (tmp_path / "b.csv").write_text('﻿Schedule B,Long Description\n8542.31.0000,"Processors, and others"\n12,short\n', encoding="utf-8")
    got = reference.read_schedule_b(spark, str(tmp_path / "b.csv")).collect()
    assert [(r.hs_code, r.description) for r in got] == [("854231", "Processors, and others")]


def test_hts_json(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"results": [{"htsno": "0101.21.00", "description": "Horses", "indent": "1", "notes": null}]}')
    assert reference.read_hts(spark, str(tmp_path / "h.json")).first().hs_code == "01012100"


def test_wco_falls_back_to_other_sheets(spark):
    empty = spark.createDataFrame([("x", "")], "HSCode string, Description string")
    full = spark.createDataFrame([("0101", "Horses", "Chevaux")], "`HS_Code` string, `Description (EN)` string, `Description (FR)` string")
    assert reference.read_wco([empty, full]).first().description == "Horses Chevaux"


def test_keywords(spark):
    raw = spark.createDataFrame([(0, " Tuna "), (1, "tuna"), (2, "ab"), (3, "cod")], "pos int, Phrases string")
    assert [r.keyword for r in reference.keywords(raw).orderBy("pos").collect()] == ["Tuna", "cod"]
    with pytest.raises(ValueError, match="none of"):
        reference.keywords(raw.withColumnRenamed("Phrases", "other"))


def test_keywords_are_all_kept_and_cut_in_length(spark):
    raw = spark.range(2500).select(F.col("id").alias("pos"), F.format_string("keyword %d", "id").alias("keyword"))
    long = spark.createDataFrame([(2500, "x" * 2000 + "a"), (2501, "x" * 2000 + "b")], "pos long, keyword string")
    got = reference.keywords(raw.union(long)).collect()
    assert {r.pos for r in got} == set(range(2502))
    assert max(len(r.keyword) for r in got) == 2000


def test_program(spark):
    program = {"source": "X", "country_iso": "ir", "restrictions": [{"description": "crude oil", "hs_codes": ["2709"], "direction": "both"}, {"description": " "}]}
    rows = reference.country_program(spark, program).collect()
    assert len(rows) == 1
    assert [(r.rule_origin, r.rule_destination) for r in rows[0].routes] == [(None, "IR"), ("IR", None)]
    for wrong in ({"country_iso": "IRN"}, {"restrictions": None}, {"restrictions": [{"description": "a", "hs_codes": ["123"]}]}, {"source": ""}):
        with pytest.raises(ValueError):
            reference.country_program(spark, program | wrong)


def test_shipments_with_errors(spark, tmp_path):
    (tmp_path / "s.csv").write_text("external_ref,commodity_text,origin_iso,destination_iso\na,steel,us,DE\nb,,US,DE\nc,brass,USA,DE\n")
    rows = reference.read_shipments(spark, str(tmp_path / "s.csv"))
    assert [(r.row_index, r.origin_iso, r.error) for r in rows.orderBy("row_index").collect()] == [(0, "US", None), (1, "US", "commodity_text is empty"), (2, None, "origin_iso is not a country code")]
    sinks.write_errors(rows, str(tmp_path / "errors"))
    assert spark.read.option("header", True).csv(str(tmp_path / "errors")).columns == list(sinks.ERROR_COLUMNS)


def test_gold_and_lines(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"description": "a", "hs_code": "123456"}\n\n# note\n')
    assert reference.read_gold(spark, str(tmp_path / "g.jsonl")).count() == 1
    (tmp_path / "q.txt").write_text("one\n\n two \n")
    assert [r.query for r in reference.read_lines(spark, str(tmp_path / "q.txt")).collect()] == ["one", "two"]


def test_rulings(spark):
    html = '<h1>NY 123456</h1><h2>Goods description</h2><p>A <b>steel</b> pipe</p><p>7304.19.1000 then 7304.19.2000 and 7306.30</p>'
    row = reference.read_rulings(spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id int, url string, html string")).where("page_id = 1").first()
    # the section goes on to the next heading; an id has no space in it
    assert (row.hs_code, row.description, row.source_id) == ("730419", "A steel pipe 7304.19.1000 then 7304.19.2000 and 7306.30", "1")


def test_canonical_urls(spark):
    urls = ["HTTP://A.com/x/?utm_source=f#top", "http://a.com/x", "http://a.com/x?page=2&ref=y"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(reference.canonical_url(F.col("u")).alias("c"))
    assert [r.c for r in got.collect()] == ["http://a.com/x", "http://a.com/x", "http://a.com/x?page=2"]


def test_crosswalk(spark):
    controls = spark.createDataFrame([("1A001",), ("9z9",)], "control_code string")
    walk = spark.createDataFrame([("1a 001", "8542.31; 12"), ("1A001", "8542.31")], "control_code string, hs_code string")
    assert {r.control_code: r.hs_codes for r in reference.with_crosswalk(controls, walk).collect()} == {"1A001": ["12", "854231"], "9z9": []}


def test_annex(spark):
    raw = spark.createDataFrame([("Pumps", "8413.70; x", "import_from"), ("No code", "n/a", "both")], "Description string, `CN code` string, Direction string")
    row = reference.read_annex(raw, "EU-A", "RU").first()
    assert (row.hs_codes, [tuple(r) for r in row.routes]) == (["841370"], [("RU", None)])


def test_results_need_a_stamp(spark, tmp_path):
    sinks.write_results(spark.createDataFrame([(1, "v1")], "id int, versions string"), str(tmp_path / "r"))
    with pytest.raises(Exception, match="version stamp"):
        sinks.write_results(spark.createDataFrame([(1, None)], "id int, versions string"), str(tmp_path / "r"))


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i % 24), "a", float(i)) for i in range(48)], "log_id long, ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("log_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    screen.screen_stream(stream, lambda b: b.groupBy("event_type").agg(F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/batch=*").agg(F.sum("n")).first()[0] == 48
    screen.run_to_parquet(screen.tail(stream, 40), str(tmp_path / "log"), str(tmp_path / "log-state"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 7
    screen.run_to_parquet(screen.windowed_counts(stream), str(tmp_path / "w"), str(tmp_path / "w-state"))
    assert spark.read.parquet(str(tmp_path / "w")).agg(F.sum("n")).first()[0] > 0


def test_munitions_list(spark, tmp_path):
    (tmp_path / "usml.csv").write_text("category,paragraph,description,hs_codes,restriction_type\nIV,(a),Rockets,9306.90; 88,\nV,,  ,1234,\nXI,,Radar sets,,prohibited\n")
    got = {r.description: r for r in reference.read_usml(spark, str(tmp_path / "usml.csv")).collect()}
    assert set(got) == {"[USML IV(a)] Rockets", "[USML XI] Radar sets"}
    one, two = got["[USML IV(a)] Rockets"], got["[USML XI] Radar sets"]
    assert one.source_record_id.startswith("USML-IV(a)-") and (one.restriction_type, two.restriction_type) == ("license_required", "prohibited")
    assert one.rule_origin == "US" and one.rule_destination is None and "930690" in one.hs_codes


def test_files_are_listed(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("12345")
    (tmp_path / "y.csv").write_text("1")
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in reference.list_files(spark, str(tmp_path)).collect()) == [("x.csv", 5), ("y.csv", 1)]


def test_writers_give_back_what_they_got(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b", 0.5, "train"), (2, 'say "x"', 1.0, "test")], "query_id int, description string, score double, split string")
    sinks.write_ranking(rows, f"{tmp_path}/rank")
    back = spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/rank")
    assert back.count() == 2 and back.columns == rows.columns
    sinks.write_splits(rows, f"{tmp_path}/split")
    assert {r.description for r in spark.read.json(f"{tmp_path}/split/split=train").collect()} == {"a,b"}
    sinks.write_json(rows, f"{tmp_path}/report")
    assert sorted(tuple(r) for r in spark.read.schema(rows.schema).json(f"{tmp_path}/report").collect()) == sorted(tuple(r) for r in rows.collect())


def test_ruling_forms(spark):
    forms = {
        1: "<title>Ruling</title><p>HQ 1 N123456</p><h2>Facts</h2><p>none</p><h3>Description of the <b>Merchandise</b></h3><p>Steel &amp; brass pipes</p><ul><li>two</li></ul><h4>End</h4><p>1111.11</p><p>2222.22 2222.22</p>",
        2: "<p><strong>Product</strong> plain <em>cotton shirt</em> more</p><p>classified in 6105.10.0000</p>",
        3: "<p>" + "a long description of the imported article " * 3 + "</p><h2>Classification</h2><p>8471.30</p><p>9999.99</p>",
        4: "<h2>Goods</h2><p>no code here</p>", 5: "<p>short</p><p>1234.56</p>", 6: None,
    }
    got = {r.page_id: (r.source_id, r.description, r.hs_code) for r in reference.read_rulings(spark.createDataFrame(list(forms.items()), "page_id int, html string")).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1] == ("N123456", "Steel &amp; brass pipes two", "222222")
    assert got[2] == ("2", "cotton shirt", "610510")
    assert got[3][2] == "847130" and got[3][1].startswith("a long description")
