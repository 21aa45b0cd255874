"""Queries of file readers and writers (§2.1, §2.2): relations are written in a file's
own form to the shared scratch folder, and the reader gives them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolore.operators import evaluation as ev
from cargolore.plans.tables import Tables
from cargolore.sources import reference as src
from cargolore.sources import sinks
from cargolore.sources.scratch import scratch_path

BOOK = 1000  # lines of one tariff file


def _csv(rows: DataFrame, name: str) -> str:
    path = scratch_path(rows.sparkSession, name)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


def _hts(t: Tables) -> DataFrame:
    """Tariff files of 1,000 lines, each one JSON object with its list under ``results``."""
    dotted = F.concat(F.substring("hs_code", 1, 4), F.lit("."), F.substring("hs_code", 5, 2)).alias("htsno")
    line = F.struct("p_partkey", dotted, "description", (F.col("p_partkey") % 4).cast("string").alias("indent"))
    book = F.floor(F.col("p_partkey") / BOOK).alias("book")
    books = t["codes"].select(book, line.alias("l")).groupBy("book").agg(F.array_sort(F.collect_list("l")).alias("results"))
    path = scratch_path(t.spark, "tariff-books")
    books.select("book", F.to_json(F.struct("results")).alias("value")).write.partitionBy("book").text(path)
    return src.read_hts(t.spark, f"{path}/*/*.txt").select("ordinal", "hs_code", "description", "indent")


def _schedule(t: Tables) -> DataFrame:
    """A schedule with codes of ten digits, of four, and rows without a text."""
    code = F.expr("concat(substring(hs_code, 1, 4), CASE WHEN p_partkey % 5 > 0 THEN concat('.', substring(hs_code, 5, 2), '.0000') ELSE '' END)")
    text = F.expr("CASE WHEN p_partkey % 7 > 0 THEN concat(' ', description, ', \"other\" ') ELSE '  ' END")
    path = _csv(t["codes"].select(code.alias("Schedule B"), text.alias("Long Description")), "schedule")
    return src.read_schedule_b(t.spark, path).select("source", "source_id", "hs_code", "description")


def _munitions(t: Tables) -> DataFrame:
    """A munitions list: every third row has no paragraph, every fifth names no restriction."""
    rows = t["codes"].select(
        F.expr("concat('Cat ', p_partkey % 21)").alias("Category"), F.expr("CASE WHEN p_partkey % 3 > 0 THEN concat('(', p_partkey % 4, ')') END").alias("Paragraph"),
        "description", F.concat("hs_code", F.lit("; 93; 1.2.3")).alias("HS_Codes"), F.expr("CASE WHEN p_partkey % 5 > 0 THEN 'blocked' END").alias("Restriction_Type"),
    )
    out = src.read_usml(t.spark, _csv(rows, "munitions"))
    return out.select("source_record_id", "description", F.array_join("hs_codes", ",").alias("codes"), "restriction_type", "rule_origin")


def _annex(t: Tables) -> DataFrame:
    """An annex whose directions are written in several ways; a fourth of its rows has no usable code."""
    raw = t["codes"].select(
        F.concat(F.lit(" "), "description").alias("Description"), F.expr("CASE WHEN p_partkey % 4 > 0 THEN concat('ex ', hs_code, ' 00') ELSE 'n/a' END").alias("CN code"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN ' Export_To ' WHEN 1 THEN 'import_from' ELSE 'both' END").alias("Direction"),
    )
    out = src.read_annex(raw, "ANNEX", "RU").select("source_record_id", "description", F.array_join("hs_codes", ",").alias("codes"), F.explode("routes").alias("r"))
    return out.select("source_record_id", "description", "codes", "r.rule_origin", "r.rule_destination")


def _batch(t: Tables) -> DataFrame:
    """Shipments as a batch file; the rows that cannot be screened go through the file of errors."""
    rows = t["shipment"].select(
        F.col("query_id").alias("external_ref"), F.expr("CASE WHEN query_id % 19 = 0 THEN ' ' ELSE text END").alias("commodity_text"),
        F.expr("CASE WHEN query_id % 23 = 0 THEN 'Q9' ELSE lower(origin) END").alias("origin_iso"), F.expr("CASE WHEN query_id % 29 = 0 THEN 'XYZ' ELSE destination END").alias("destination_iso"),
    )
    path = scratch_path(t.spark, "errors")
    sinks.write_errors(src.read_shipments(t.spark, _csv(rows, "batch")), path)
    return src.read_csv(t.spark, path).select("external_ref", "error")


def _gold(t: Tables) -> DataFrame:
    """Gold lines with comments and blank lines between them."""
    line = F.to_json(F.struct("description", "hs_code"))
    lines = t["codes"].select(F.explode(F.array(F.lit(" # note"), line, F.when(F.col("p_partkey") % 2 == 0, F.lit("   ")).otherwise(F.lit("")))).alias("value"))
    path = scratch_path(t.spark, "gold")
    lines.write.text(path)
    return src.read_gold(t.spark, path)


def _lines(t: Tables) -> DataFrame:
    """Queries of a comparison, one a line, with blank lines between them."""
    path = scratch_path(t.spark, "parity-queries")
    t["part"].select(F.explode(F.array(F.concat(F.lit("  "), "p_name"), F.lit(""))).alias("value")).write.text(path)
    return src.read_lines(t.spark, path).groupBy("query").agg(F.count("*").alias("n"))


def _listed(t: Tables) -> DataFrame:
    """The files under a folder with one subfolder a chapter."""
    path = scratch_path(t.spark, "listing")
    chapters = t["codes"].select(F.substring("hs_code", 1, 2).alias("chapter"), F.col("title").alias("value"))
    chapters.repartition("chapter").write.partitionBy("chapter").text(path)
    return src.list_files(t.spark, path).select(F.regexp_extract("path", "chapter=([0-9]+)", 1).alias("chapter"), "length").groupBy("chapter").agg(F.sum("length").alias("bytes"))


def _stored(t: Tables) -> DataFrame:
    """Results are kept with the version that made them."""
    path = scratch_path(t.spark, "results")
    sinks.write_results(t["result"].select("result_id", "origin", F.lit("engine=1").alias("versions")), path)
    return t.spark.read.parquet(path)


def _ranking(t: Tables) -> DataFrame:
    """The ranking dataset as a file."""
    path = scratch_path(t.spark, "ranking")
    sinks.write_ranking(ev.ranking_rows(t["ranked"], t["gold"]), path)
    return src.read_csv(t.spark, path).select(*(F.col(c).cast("bigint").alias(c) for c in ("query_id", "place", "grade")), "hs_code", "gold")


def _report(t: Tables) -> DataFrame:
    """Calibration figures as a report."""
    path = scratch_path(t.spark, "report")
    sinks.write_json(ev.sweep(t["record"], t.spark.range(1, 20).select(F.round(F.col("id") / 20, 2).alias("threshold"))), path)
    return t.spark.read.schema("threshold double, precision double, coverage double").json(path)


_ERROR = """CASE WHEN query_id % 19 = 0 THEN 'commodity_text is empty' WHEN query_id % 23 = 0 THEN 'origin_iso is not a country code' WHEN query_id % 29 = 0 THEN 'destination_iso is not a country code' END"""

QUERIES = {
    "read_tariff": (
        _hts,
        "SELECT row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) - 1 AS ordinal, hs_code, description, (p_partkey % 4)::INT AS indent FROM codes"),
    "read_schedule": (
        _schedule,
        """SELECT 'schedule_b' AS source, hs_code || '0000' AS source_id, hs_code, description || ', "other"' AS description FROM codes WHERE p_partkey % 5 > 0 AND p_partkey % 7 > 0"""),
    "read_munitions": (
        _munitions,
        """WITH m AS (SELECT *, 'Cat ' || p_partkey % 21 AS cat, CASE WHEN p_partkey % 3 > 0 THEN '(' || p_partkey % 4 || ')' ELSE '' END AS para FROM codes)
        SELECT 'USML-' || cat || para || '-' || substring(sha1(description), 1, 10) AS source_record_id, '[USML ' || cat || para || '] ' || description AS description, hs_code || ',93' AS codes,
          CASE WHEN p_partkey % 5 > 0 THEN 'blocked' ELSE 'license_required' END AS restriction_type, 'US' AS rule_origin FROM m"""),
    "read_annex": (
        _annex,
        """WITH a AS (SELECT 'ANNEX-' || substring(sha1(description), 1, 12) AS source_record_id, description, hs_code AS codes, p_partkey % 3 AS d FROM codes WHERE p_partkey % 4 > 0)
        SELECT source_record_id, description, codes, NULL::VARCHAR AS rule_origin, 'RU' AS rule_destination FROM a WHERE d IN (0, 2)
        UNION ALL SELECT source_record_id, description, codes, 'RU', NULL FROM a WHERE d IN (1, 2)"""),
    "batch_errors": (_batch, f"SELECT external_ref, error FROM (SELECT query_id::VARCHAR AS external_ref, {_ERROR} AS error FROM shipment) WHERE error IS NOT NULL"),
    "read_gold": (_gold, "SELECT description, hs_code FROM codes"),
    "read_parity_queries": (_lines, "SELECT p_name AS query, count(*) AS n FROM part GROUP BY 1"),
    "file_listing": (_listed, "SELECT substring(hs_code, 1, 2) AS chapter, sum(strlen(title) + 1)::BIGINT AS bytes FROM codes GROUP BY 1"),
    "stored_results": (_stored, "SELECT result_id, origin, 'engine=1' AS versions FROM result"),
    "ranking_file": (
        _ranking,
        """SELECT r.query_id, place::BIGINT AS place, hs_code, gold, CASE WHEN hs_code = gold THEN 4 WHEN substring(hs_code, 1, 4) = substring(gold, 1, 4) THEN 3 WHEN substring(hs_code, 1, 2) = substring(gold, 1, 2) THEN 2
        WHEN abs(substring(hs_code, 1, 2)::INT - substring(gold, 1, 2)::INT) = 1 THEN 1 ELSE 0 END::BIGINT AS grade FROM ranked AS r JOIN gold USING (query_id)"""),
    "report_file": (
        _report,
        """WITH g AS (SELECT round(i / 20.0, 2)::DOUBLE AS threshold FROM range(1, 20) AS x(i))
        SELECT threshold, coalesce(round(count(*) FILTER (score >= threshold AND correct) / nullif(count(*) FILTER (score >= threshold), 0)::DOUBLE, 6), 0) AS precision,
          coalesce(round(count(*) FILTER (score >= threshold) / count(*)::DOUBLE, 6), 0) AS coverage FROM g, record GROUP BY 1"""),
}
