"""Queries over screening results, runs and reference counts (§2.3, §2.5-2.7)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolore.operators import dashboards as d
from cargolore.plans.tables import Tables

NOW = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def nested(t: Tables) -> DataFrame:
    """Results with their candidates (best first), sanction and rule matches."""
    def lists(name: str, out: str, *fields: str, best: tuple = ()) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(*best, *fields)))
        return t[name].groupBy("result_id").agg(F.transform(items, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(out))

    out = t["result"].withColumn("query_id", F.col("result_id"))
    out = out.join(lists("candidate", "top_candidates", "hs_code", "chapter", "score", best=((-F.col("score")).alias("__b"), F.col("line").alias("__l"))), "result_id", "left")
    return out.join(lists("match", "sanction_matches", "source", "similarity"), "result_id", "left").join(lists("hit", "rule_matches", "rule_id", "delta"), "result_id", "left")


_FLAT = """WITH best AS (SELECT result_id, arg_min(hs_code, (-score, line)) AS code, arg_min(chapter, (-score, line)) AS chapter, arg_min(score, (-score, line)) AS score FROM candidate GROUP BY result_id),
m AS (SELECT result_id, count(*) AS n, max(similarity) AS s FROM "match" GROUP BY result_id), h AS (SELECT result_id, count(*) AS n, max(delta) AS s FROM hit GROUP BY result_id),
f AS (SELECT r.*, code, chapter, best.score, coalesce(m.n, 0) AS n_m, coalesce(m.s, 0.0) AS s_m, coalesce(h.n, 0) AS n_h, coalesce(h.s, 0.0) AS s_h FROM result AS r LEFT JOIN best USING (result_id) LEFT JOIN m USING (result_id) LEFT JOIN h USING (result_id)),
v AS (SELECT result_id, origin, destination, created_at, coalesce(abstained, FALSE) AS abstained, code AS top_code, score AS top_score, n_m::INT AS sanctions_count, s_m AS max_sanction_similarity, n_h::INT AS rules_count, s_h AS max_rule_delta,
      round(s_m + 0.5 * s_h + CASE WHEN coalesce(abstained, FALSE) THEN 0.3 ELSE 0.0 END, 6) AS risk FROM f)
"""


def _ages(t: Tables) -> DataFrame:
    return d.freshness(t["run"], NOW)


_LATEST = """WITH l AS (SELECT * FROM run WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) = 1),
a AS (SELECT source, kind, greatest(0, floor((epoch(TIMESTAMP '2024-03-01') - floor(epoch(finished_at))) / 86400))::INT AS days FROM l),
s AS (SELECT source, kind, days, CASE WHEN days IS NULL THEN 'gray' WHEN days <= CASE WHEN kind = 'taxonomy' THEN 90 ELSE 7 END THEN 'green' WHEN days <= CASE WHEN kind = 'taxonomy' THEN 365 ELSE 30 END THEN 'amber' ELSE 'red' END AS severity FROM a)
"""


def _history(t: Tables) -> DataFrame:
    return d.rule_history(t["screening"]).select("name", "version", "age", "is_latest")


def _batches(t: Tables) -> DataFrame:
    rows = t["orders"].select((F.col("o_orderkey") % 50).alias("batch_id"), F.expr("CASE WHEN o_orderkey % 50 = 7 THEN 'failed' WHEN o_orderkey % 50 = 9 AND o_orderkey % 3 = 0 THEN 'pending' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END").alias("status"))
    return d.batch_progress(rows)


QUERIES = {
    "result_rows": (lambda t: d.result_rows(nested(t)), _FLAT + "SELECT * FROM v"),
    "results_filtered": (
        lambda t: d.result_rows(d.filter_results(nested(t), since=dt.datetime(1995, 1, 1), abstained=False, has_rules=True, min_score=0.5)),
        _FLAT + "SELECT v.* FROM v WHERE created_at >= TIMESTAMP '1995-01-01' AND NOT coalesce(abstained, FALSE) AND rules_count > 0 AND top_score >= 0.5"),
    "results_by_route": (
        lambda t: d.result_rows(d.filter_results(nested(t), origin="BH", has_sanctions=True)), _FLAT + "SELECT * FROM v WHERE origin = 'BH' AND sanctions_count > 0"),
    "results_in_chapter": (lambda t: d.result_rows(d.filter_results(nested(t), chapter="42")), _FLAT + "SELECT v.* FROM v JOIN f USING (result_id) WHERE chapter = '42'"),
    "results_risk_sorted": (lambda t: d.page(nested(t), "risk_desc", 50), _FLAT + "SELECT * FROM v ORDER BY risk DESC, created_at DESC, result_id LIMIT 50"),
    "results_confidence_sorted": (lambda t: d.page(nested(t), "confidence_asc", 50), _FLAT + "SELECT * FROM v ORDER BY coalesce(top_score, 0.0), created_at DESC, result_id LIMIT 50"),
    "results_page": (lambda t: d.page(nested(t), "recent", 25, 100), _FLAT + "SELECT * FROM v ORDER BY created_at DESC, result_id LIMIT 25 OFFSET 100"),
    "results_count": (lambda t: d.count_results(d.filter_results(nested(t), has_rules=True)), _FLAT + "SELECT count(*) AS n FROM f WHERE n_h > 0"),
    "chapter_volume": (lambda t: d.chapter_volume(nested(t)), _FLAT + "SELECT coalesce(chapter, '?') AS chapter, count(*) AS n FROM f GROUP BY 1"),
    "sanction_hits_by_source": (lambda t: d.hits_by_source(nested(t)), 'SELECT coalesce(source, \'?\') AS source, count(*) AS n FROM "match" JOIN result USING (result_id) GROUP BY 1'),
    "result_route_heatmap": (lambda t: d.route_counts(t["result"]), "SELECT coalesce(origin, '?') AS origin, coalesce(destination, '?') AS destination, count(*) AS n FROM result GROUP BY 1, 2"),
    "score_histogram": (lambda t: d.score_histogram(nested(t)), _FLAT + "SELECT CASE WHEN score < 0 THEN 0 WHEN score >= 1 THEN 11 ELSE 1 + floor(score * 10)::BIGINT END AS bucket, count(*) AS n FROM f WHERE score IS NOT NULL GROUP BY 1"),
    "override_rate_trend": (
        lambda t: d.override_rate(t["result"], t["feedback"]),
        """SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (kind = 'override') AS overridden, round(count(*) FILTER (kind = 'override') / count(*), 6) AS rate,
           count(DISTINCT r.result_id) AS results, count(DISTINCT r.result_id) FILTER (kind = 'override') AS results_overridden FROM result AS r LEFT JOIN feedback AS f USING (result_id) GROUP BY 1"""),
    "rule_scope_heatmap": (
        lambda t: d.route_counts(t["rules"].where("active").select(F.col("rule_origin").alias("origin"), F.col("rule_destination").alias("destination")), "*"),
        "SELECT coalesce(rule_origin, '*') AS origin, coalesce(rule_destination, '*') AS destination, count(*) AS n FROM rules WHERE active GROUP BY 1, 2"),
    "commodities_by_source": (lambda t: d.count_by(t["goods"], "source"), "SELECT source, count(*) AS n FROM goods GROUP BY 1"),
    "source_counts": (lambda t: d.count_by(t["goods"].where("sys_to IS NULL"), "source"), "SELECT source, count(*) AS n FROM goods WHERE sys_to IS NULL GROUP BY 1"),
    "level_counts": (lambda t: d.count_by(t["taxonomy"], "level"), "SELECT level, count(*) AS n FROM taxonomy GROUP BY 1"),
    "examples_by_source": (lambda t: d.count_by(t["documents"], "source"), "SELECT source, count(*) AS n FROM documents GROUP BY 1"),
    "rules_by_creator": (
        lambda t: d.count_by(t["screening"].where("active").select(F.regexp_replace("created_by", "^sanctions_source:", "").alias("creator")), "creator"),
        "SELECT regexp_replace(created_by, '^sanctions_source:', '') AS creator, count(*) AS n FROM screening WHERE active GROUP BY 1"),
    "keyword_list_counts": (
        lambda t: d.list_counts(t.spark.createDataFrame([("metals",), ("foods",), ("none",)], "name string"), t["goods"], t["screening"]),
        """SELECT name, (SELECT count(*) FROM goods WHERE sys_to IS NULL AND source = 'KW:' || name) AS n_goods,
           (SELECT count(*) FROM screening WHERE active AND created_by = 'sanctions_source:KW:' || name) AS n_rules FROM (VALUES ('metals'), ('foods'), ('none')) AS x(name)"""),
    "latest_run_per_source": (
        lambda t: d.latest_runs(t["run"]).select("source", "run_id", "started_at", "status"),
        "SELECT source, run_id, started_at, status FROM run QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) = 1"),
    "staleness": (lambda t: _ages(t), _LATEST + "SELECT * FROM s"),
    "worst_staleness": (lambda t: d.worst(_ages(t)), _LATEST + "SELECT arg_max(severity, list_position(['green', 'amber', 'gray', 'red'], severity)) AS worst FROM s"),
    "hs_search": (
        lambda t: d.search_titles(t["taxonomy"], "RED", 6).select("hs_code", "title"), "SELECT hs_code, title FROM taxonomy WHERE title ILIKE '%red%' AND level = 6"),
    "hs_children": (lambda t: d.children(t["taxonomy"]), "SELECT a.hs_code, b.hs_code AS child FROM taxonomy AS a JOIN taxonomy AS b ON b.parent_code = a.hs_code"),
    "hs_tree": (lambda t: t["taxonomy"].where(F.startswith("hs_code", F.lit("12"))).select("hs_code", "level", "parent_code"), "SELECT hs_code, level, parent_code FROM taxonomy WHERE hs_code LIKE '12%'"),
    "rule_history": (lambda t: _history(t), "SELECT name, version, row_number() OVER w AS age, row_number() OVER w = 1 AS is_latest FROM screening WINDOW w AS (PARTITION BY name ORDER BY version DESC)"),
    "batch_progress": (
        _batches,
        """WITH b AS (SELECT o_orderkey % 50 AS batch_id, CASE WHEN o_orderkey % 50 = 7 THEN 'failed' WHEN o_orderkey % 50 = 9 AND o_orderkey % 3 = 0 THEN 'pending' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM orders),
        c AS (SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM b GROUP BY 1)
        SELECT *, CASE WHEN completed + failed < total THEN 'running' WHEN completed = 0 THEN 'failed' ELSE 'done' END AS state FROM c"""),
}
