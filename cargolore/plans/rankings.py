"""Queries of retrieval, fusion, sanctions and rules (§2.4, §2.6, §2.8, §2.10)."""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolore.functions.predicates import browses, effective
from cargolore.functions.scores import lexical_logit, sigmoid
from cargolore.operators import dashboards, fulltext
from cargolore.operators import retrieval as r
from cargolore.operators import screening as s
from cargolore.plans.tables import Tables
from cargolore.plans.texts import covers_sql, logit_sql, similarity_sql, trigrams_sql

DAY = dt.date(1998, 1, 1)


def _dense(t: Tables) -> DataFrame:
    v = t["embeddings"]
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return r.dense_topk(queries, v.select(F.col("vec_id").alias("hs_code"), F.col("embedding").alias("v")), 10)


def _dense_taught(t: Tables) -> DataFrame:
    """Each hit also is one of a labelled example, whose code is the least of four."""
    found = _dense(t).persist(StorageLevel.DISK_ONLY)  # read twice
    taught = found.select("query_id", F.expr("hs_code - hs_code % 4").alias("hs_code"), F.col("similarity").alias("score"))
    return r.with_training(found.withColumnRenamed("similarity", "score"), taught, "dense_similarity", "dense_via_training", 0.95)


_DENSE = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS hs_code, list_cosine_similarity(a.e, b.e) AS s FROM v AS a, v AS b WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, hs_code) - 1 AS pos FROM d QUALIFY pos < 10)
"""


def _names(t: Tables) -> DataFrame:
    return t["part"].groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("query_id"))


def _asked(t: Tables) -> DataFrame:
    """Questions of three words and a stop word."""
    return t["part"].groupBy(F.concat("p_name", F.lit(" of the "), "p_type").alias("text")).agg(F.min("p_partkey").alias("query_id"))


_ASKED = "SELECT p_name || ' of the ' || p_type AS text, min(p_partkey) AS query_id FROM part GROUP BY 1"


def _sparse(t: Tables) -> DataFrame:
    text = F.concat(F.col("description"), F.lit(" of "), "title", F.lit("; the "), F.split("description", " ")[2], F.lit(" standard "), F.split("title", " ")[1])
    index = fulltext.indexed(t["codes"].select("p_partkey", text.alias("text")), key="p_partkey")
    return r.sparse_topk(_asked(t), index, 20, key="p_partkey")


_TOLD = "SELECT p_partkey AS key, description || ' of ' || title || '; the ' || split_part(description, ' ', 3) || ' standard ' || split_part(title, ' ', 2) AS text FROM codes"
_SPARSE = f"""WITH {covers_sql(_ASKED, _TOLD)},
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, key) - 1 AS pos FROM rk QUALIFY pos < 20)
SELECT query_id, key AS p_partkey, pos, round(rank / max(rank) OVER (PARTITION BY query_id), 6) AS sparse_score FROM k"""


def _taught(t: Tables) -> DataFrame:
    index = fulltext.indexed(t["codes"].groupBy("hs_code").agg(F.min("description").alias("text")))
    examples = t["part"].select(F.col("p_partkey").alias("example_id"), F.concat_ws(" ", "p_name", "p_name", "p_brand").alias("text")).join(t["codes"].select(F.col("p_partkey").alias("example_id"), "hs_code"), "example_id")
    return r.sparse_with_training(_names(t), index, examples, 5)


_NAMED = "SELECT p_name AS text, min(p_partkey) AS query_id FROM part GROUP BY 1"
_TAUGHT = f"""WITH {covers_sql(_NAMED, "SELECT hs_code AS key, min(description) AS text FROM codes GROUP BY 1", name="ck")},
{covers_sql(_NAMED, "SELECT p_partkey AS key, p_name || ' ' || p_name || ' ' || p_brand AS text FROM part", name="xk")},
k AS (SELECT query_id, key AS hs_code, rank FROM ck QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, key) <= 5),
m AS (SELECT query_id, hs_code, rank FROM (SELECT * FROM xk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, key) <= 5) JOIN codes ON p_partkey = key),
b AS (SELECT *, rank AS best FROM k UNION ALL SELECT query_id, hs_code, 0.9::DOUBLE * rank, rank FROM m), s AS (SELECT query_id, hs_code, rank / max(best) OVER (PARTITION BY query_id) AS score FROM b)
SELECT query_id, hs_code, round(max(score), 6) AS sparse_score FROM s GROUP BY ALL"""


def _entities(t: Tables) -> tuple[DataFrame, DataFrame]:
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("entity_type"), F.col(c).alias("entity_value"), F.lit(w).alias("weight")) for k, c, w in (("material", "p_name", 1.0), ("form", "p_type", 0.8), ("brand", "p_brand", 0.5)))))
    each = t["part"].select("p_partkey", pairs.alias("e")).select("p_partkey", "e.*")
    index = each.join(t["codes"].select("p_partkey", "hs_code"), "p_partkey").groupBy("hs_code", "entity_type", "entity_value").agg(F.max("weight").alias("weight"))
    return each.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), "entity_type", "entity_value"), index


_ENTITY = """WITH e AS (SELECT p_partkey, 'material' AS t, p_name AS v, 1.0::DOUBLE AS w FROM part UNION ALL SELECT p_partkey, 'form', p_type, 0.8 FROM part UNION ALL SELECT p_partkey, 'brand', p_brand, 0.5 FROM part),
i AS (SELECT hs_code, t, v, max(w) AS w FROM e JOIN codes USING (p_partkey) GROUP BY ALL),
f AS (SELECT q.p_partkey AS query_id, hs_code, sum(i.w) AS weight FROM e AS q JOIN i USING (t, v) WHERE q.p_partkey % 20 = 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, hs_code) - 1 AS pos FROM f QUALIFY pos < 50)
SELECT query_id, hs_code, pos, round(weight / max(weight) OVER (PARTITION BY query_id), 6) AS entity_overlap_score FROM k"""


def _branches(t: Tables) -> dict[str, DataFrame]:
    own = lambda i, name: t["branch"].where(F.col("b") == i).select("query_id", "hs_code", "pos", F.col("value").alias(name))
    return {"dense": own(0, "dense_similarity"), "sparse": own(1, "sparse_score"), "entity": own(2, "entity_overlap_score")}


_UNION = """WITH un AS (SELECT query_id, hs_code, coalesce(max(value) FILTER (b = 0), 0) AS d, coalesce(max(value) FILTER (b = 1), 0) AS s, coalesce(max(value) FILTER (b = 2), 0) AS e, sum(1.0::DOUBLE / (60 + pos + 1)) AS rrf, substring(hs_code, 1, 2) AS chapter FROM branch GROUP BY ALL)"""


def _scorer(query: Column, text: Column) -> Column:
    """A stand-in for a model that the comparison engine can compute."""
    return (F.length(text) * 7 + F.ascii(F.substring(text, 8, 1)) + F.length(query)) % 23 / 8.0 - 1.4


def _ranked(t: Tables) -> DataFrame:
    queries = t["orders"].select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("text"))
    merged = r.union(_branches(t)).drop("title", "description").join(t["taxonomy"].where("level = 6").select("hs_code", "title", "description"), "hs_code", "left")
    return r.fuse(r.rerank(merged, queries, _scorer, base=2, cap=4))


_FUSED = _UNION + """, hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, hs_code) - 1 AS pos, lag(rrf) OVER (PARTITION BY query_id ORDER BY rrf DESC, hs_code) - rrf AS gap FROM un),
hd AS (SELECT *, pos < 4 AND max(CASE WHEN pos >= 2 AND NOT gap < 0.001 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY pos) = 0 AS in_head FROM hr),
tx AS (SELECT hd.*, 'HS ' || hd.hs_code || ' (ch ' || hd.chapter || '): ' || title || CASE WHEN title = description THEN '' ELSE ' ' || description END AS txt, o_orderpriority AS q
       FROM hd JOIN taxonomy AS x ON x.hs_code = hd.hs_code AND x.level = 6 JOIN orders ON o_orderkey = query_id),
ce AS (SELECT *, CASE WHEN in_head THEN 1 / (1 + exp(-((length(txt) * 7 + ascii(substring(txt, 8, 1)) + length(q)) % 23 / 8.0::DOUBLE - 1.4::DOUBLE))) ELSE d END AS ce FROM tx),
ft AS (SELECT *, count(*) OVER (PARTITION BY query_id, chapter)::DOUBLE / count(*) OVER (PARTITION BY query_id) AS prior,
       greatest(0, nth_value(ce, 1) OVER w - coalesce(nth_value(ce, 2) OVER w, 0)) AS g FROM ce WINDOW w AS (PARTITION BY query_id ORDER BY ce DESC, hs_code ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
sc AS (SELECT *, round(0.0::DOUBLE + 0.2::DOUBLE * d + 0.1::DOUBLE * s + 0.15::DOUBLE * e + 0.45::DOUBLE * ce + 0.05::DOUBLE * prior + 0.0::DOUBLE + 0.05::DOUBLE * g + 0.0::DOUBLE, 4) AS score FROM ft),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) - 1 AS place FROM sc)
"""
_CONF = _FUSED + """, nm AS (SELECT *, CASE WHEN sum(greatest(score, 0)) OVER (PARTITION BY query_id) > 0 THEN greatest(score, 0) / sum(greatest(score, 0)) OVER (PARTITION BY query_id) ELSE 0 END AS p FROM pl WHERE place < 10),
ch AS (SELECT query_id, chapter, sum(p) AS share FROM nm GROUP BY ALL), cs AS (SELECT query_id, round(max(share)::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS chapter_consensus FROM ch GROUP BY 1),
cf AS (SELECT query_id, round(max(score) FILTER (place = 0), 4) AS top1_score, round(max(score) FILTER (place = 0) - coalesce(max(score) FILTER (place = 1), 0), 4) AS top1_minus_top2,
       round(0 - sum(CASE WHEN p > 0 THEN p * ln(p + 1e-12) ELSE 0 END), 4) + 0.0 AS entropy_topk, coalesce(bool_or(place = 0 AND round(d, 4) > 0.4 AND round(s, 4) > 0 AND round(ce, 4) > 0.4), FALSE) AS cross_source_agreement, max(hs_code) FILTER (place = 0) AS top_code FROM nm GROUP BY 1)
"""


def _confidence(t: Tables) -> DataFrame:
    return r.confidence(_ranked(t))


def _abstained(t: Tables) -> DataFrame:
    queries = t["orders"].select(F.col("o_orderkey").alias("query_id"))
    return r.abstention(queries, r.confidence(_ranked(t)), top1=0.5, gap=0.02, floor=0.6).select("query_id", "abstained", "abstain_reason", "fallback_level", "fallback_code")


def _shipped(t: Tables) -> DataFrame:
    return t["shipment"].select("query_id", "origin", "destination", "text", F.array("hs_code").alias("codes"), "value", "currency", F.create_map(F.lit("mode"), "currency").alias("metadata"))


def _structured(t: Tables) -> DataFrame:
    return s.structured(_shipped(t), s.active_goods(t["goods"], DAY), t["rules"])


_STRUCTURED = """WITH ag AS (SELECT * FROM goods WHERE sys_to IS NULL AND (valid_from IS NULL OR valid_from <= DATE '1998-01-01') AND (valid_to IS NULL OR valid_to >= DATE '1998-01-01')),
st AS (SELECT query_id, origin, destination, g.id, any_value(s.hs_code) AS code, min(restriction_type) AS restriction_type, count(*) AS n_rules
       FROM shipment AS s JOIN (SELECT id, unnest(hs_codes) AS hs_code FROM ag) AS g USING (hs_code) JOIN rules AS u ON u.id = g.id AND u.active AND (rule_origin IS NULL OR rule_origin = origin) AND (rule_destination IS NULL OR rule_destination = destination) GROUP BY ALL)
"""


def _paths(t: Tables) -> dict[str, DataFrame]:
    """Four match paths of each order: by its lines' parts and amounts."""
    line = t["lineitem"].select(F.col("l_orderkey").alias("query_id"), "l_linenumber", F.col("l_partkey").alias("id"), ((F.col("l_partkey") % 64) / 64).alias("similarity"), "l_suppkey")
    line = line.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"), F.min("l_linenumber").alias("n"))
    return {
        "structured": line.where("n = 1").select("query_id", "id"), "dense": line.select("query_id", "id", "similarity"),
        "sparse": line.where("n % 2 = 0").select("query_id", "id", (F.col("similarity") * 5 + 1).alias("similarity")), "alias": line.where("n % 3 = 0").select("query_id", "id", (1 - F.col("similarity")).alias("similarity")),
    }


def _merged(t: Tables, mode: str = "rrf") -> DataFrame:
    goods = t["codes"].select(F.col("p_partkey").alias("id"), "description")
    queries = t["orders"].select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("text"))
    out = s.merge_matches(_paths(t), goods, queries, head=2, mode=mode, scorer=lambda q, x: (F.length(q) * 5 + F.length(x)) % 13 / 4.0 - 1.5)
    return out.select("query_id", "id", "pos", "structured_match", F.round("sparse", 6).alias("sparse"), "similarity", "rrf_score")


def _merged_sql(mode: str) -> str:
    fused = "rrf + CASE WHEN structured_match THEN 1.0::DOUBLE / 61 ELSE 0 END" if mode == "rrf" else "greatest(dense, sparse, alias) + CASE WHEN structured_match THEN 0.3::DOUBLE ELSE 0 END"
    return f"""WITH li AS (SELECT l_orderkey AS query_id, l_partkey AS id, (l_partkey % 64) / 64.0::DOUBLE AS sim, min(l_linenumber) AS n FROM lineitem GROUP BY ALL),
pa AS (SELECT query_id, id, 'structured' AS path, 1.0::DOUBLE AS v FROM li WHERE n = 1 UNION ALL SELECT query_id, id, 'dense', sim FROM li UNION ALL SELECT query_id, id, 'sparse', sim * 5 + 1 FROM li WHERE n % 2 = 0 UNION ALL SELECT query_id, id, 'alias', 1 - sim FROM li WHERE n % 3 = 0),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY v DESC, id) - 1 AS pos FROM pa),
gr AS (SELECT query_id, id, coalesce(max(v) FILTER (path = 'dense'), 0) AS dense, coalesce(max(v) FILTER (path = 'sparse'), 0) AS sp, coalesce(max(v) FILTER (path = 'alias'), 0) AS alias, bool_or(path = 'structured') AS structured_match, sum(1.0::DOUBLE / (60 + pos + 1)) AS rrf FROM ra GROUP BY ALL),
no AS (SELECT *, coalesce(sp / nullif(max(sp) OVER (PARTITION BY query_id), 0), 0) AS sparse FROM gr),
fu AS (SELECT *, round({fused}, 6) AS rrf_score FROM no), po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) - 1 AS pos FROM fu)
SELECT query_id, id, pos, structured_match, round(sparse, 6) AS sparse, round(greatest(dense, alias, CASE WHEN pos < 2 THEN 1 / (1 + exp(-((length(o_orderpriority) * 5 + length(description)) % 13 / 4.0::DOUBLE - 1.5::DOUBLE))) ELSE 0 END), 4) AS similarity, rrf_score
FROM po JOIN codes ON p_partkey = id JOIN orders ON o_orderkey = query_id"""


def _aliases(t: Tables) -> DataFrame:
    parties = t["supplier"].join(t["part"], F.col("p_partkey") == F.col("s_suppkey") + 1).select(F.col("s_suppkey").alias("query_id"), F.concat_ws(" ", "s_name", "p_name").alias("name"))
    goods = t["part"].select(F.col("p_partkey").alias("id"), F.concat(F.lit("Goods "), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(" "), "p_name").alias("alias"))
    return s.alias_matches(parties, goods).withColumn("similarity", F.round("similarity", 6))


_ALIASES = f"""WITH a AS (SELECT s_suppkey AS query_id, {trigrams_sql("s_name || ' ' || p_name")} AS g FROM supplier JOIN part ON p_partkey = s_suppkey + 1), b AS (SELECT p_partkey AS id, {trigrams_sql("'Goods ' || lpad(p_partkey::VARCHAR, 9, '0') || ' ' || p_name")} AS h FROM part)
SELECT query_id, id, round({similarity_sql('g', 'h')}, 6) AS similarity FROM a, b WHERE {similarity_sql('g', 'h')} >= 0.3"""


def _routes(t: Tables, key: str) -> list[Column]:
    iso = lambda k: F.expr(f"concat(chr(cast(65 + ({k}) % 26 as int)), chr(cast(65 + (({k}) * 7) % 26 as int)))")
    return [iso(f"{key} % 25").alias("origin"), iso(f"({key} * 3) % 25").alias("destination")]


def _dense_goods(t: Tables) -> DataFrame:
    v = t["embeddings"]
    shipments = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), *_routes(t, "vec_id"))
    goods = v.select((F.col("vec_id") * 5).alias("id"), F.col("embedding").alias("v"))
    return s.dense_matches(shipments, goods, t["rules"], 10).withColumn("similarity", F.round("similarity", 6))


_ROUTE_SQL = "chr((65 + ({k} % 25) % 26)::INT) || chr((65 + (({k} % 25) * 7) % 26)::INT)"
# routes are tested before order and limit
_ON_ROUTE = f"""EXISTS (SELECT 1 FROM rules AS r WHERE r.id = g.id AND active AND (rule_origin IS NULL OR rule_origin = {_ROUTE_SQL.format(k="g.query_id")})
  AND (rule_destination IS NULL OR rule_destination = {_ROUTE_SQL.format(k="(g.query_id * 3)")}))"""
_DENSE_GOODS = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT a.vec_id AS query_id, b.vec_id * 5 AS id, list_cosine_similarity(a.e, b.e) AS s FROM v AS a, v AS b WHERE a.vec_id % 20 = 0)
SELECT query_id, id, round(s, 6) AS similarity FROM g WHERE {_ON_ROUTE} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 10"""


def _sparse_goods(t: Tables) -> DataFrame:
    shipments = _names(t).select("query_id", "text", *_routes(t, "query_id"))
    text = F.concat("description", F.lit(" of the "), "p_size", F.lit(" "), "title").alias("description")
    return s.sparse_matches(shipments, t["codes"].select(F.col("p_partkey").alias("id"), text), t["rules"], 20)


_SPARSE_GOODS = f"""WITH {covers_sql(_NAMED, "SELECT p_partkey AS key, description || ' of the ' || p_size || ' ' || title AS text FROM codes", "simple")},
g AS (SELECT query_id, key AS id, rank FROM rk)
SELECT query_id, id, rank AS similarity FROM g WHERE {_ON_ROUTE} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id) <= 20"""


def _rule_matches(t: Tables) -> DataFrame:
    null_map = F.lit(None).cast("map<string,string>")
    cond = F.struct("min_value", F.lit(None).cast("double").alias("max_value"), F.when(F.col("only_currency").isNotNull(), F.array("only_currency")).alias("currency_in"), null_map.alias("metadata_eq"))
    rules = t["screening"].withColumns({"conditions": cond, "phrase_group": F.struct("mode", F.col("group_phrases").alias("phrases"))}).drop("mode")
    return s.score_rules(_shipped(t), rules, lambda q, p: (F.length(q) * 3 + F.length(p) * 5) % 11 / 3.0 - 1.6)


_RULES = """WITH rm AS (SELECT query_id, rule_id, r.phrase, threshold, created_by, version, CASE WHEN group_phrases IS NULL THEN 'single' WHEN mode IN ('any_of', 'all_of') THEN mode ELSE 'any_of' END AS mode,
  list_transform(coalesce(group_phrases, [r.phrase]), lambda p: round(1 / (1 + exp(-((length(text) * 3 + length(p) * 5) % 11 / 3.0::DOUBLE - 1.6::DOUBLE))), 6)) AS each,
  (min_value IS NULL OR value >= min_value) AND (only_currency IS NULL OR only_currency = currency) AS conditions_satisfied
  FROM shipment AS s JOIN screening AS r ON r.active AND (rule_origin IS NULL OR rule_origin = origin) AND (rule_destination IS NULL OR rule_destination = destination)),
rs AS (SELECT *, round(CASE WHEN mode = 'all_of' THEN list_min(each) ELSE list_max(each) END, 4) AS phrase_similarity FROM rm)
"""


def _draft_test(t: Tables) -> DataFrame:
    """A drafted phrase held against all goods texts."""
    return t["taxonomy"].where("level = 6").select("hs_code", F.round(sigmoid(lexical_logit(F.lit("large brushed steel box"), F.col("description"))), 4).alias("similarity"))


QUERIES = {
    "route_heatmap": (lambda t: dashboards.route_counts(_structured(t)), _STRUCTURED + "SELECT coalesce(origin, '?') AS origin, coalesce(destination, '?') AS destination, count(*) AS n FROM st GROUP BY 1, 2"),
    "structured_sanctions": (
        lambda t: _structured(t).select("query_id", "id", F.array_join("hs_code_overlap", ",").alias("codes"), "restriction_type", "n_rules"),
        _STRUCTURED + "SELECT query_id, id, code AS codes, restriction_type, n_rules FROM st"),
    "sanctions_by_country_pair": (
        lambda t: t["goods"].where("sys_to IS NULL").join(t["rules"].where(F.col("active") & browses(F.col("rule_origin"), "BH") & browses(F.col("rule_destination"), None)), "id").groupBy("id", "source").agg(F.count("*").alias("n_rules")),
        "SELECT g.id, source, count(*) AS n_rules FROM goods AS g JOIN rules AS r ON r.id = g.id WHERE sys_to IS NULL AND active AND (rule_origin IS NULL OR rule_origin = 'BH') GROUP BY ALL"),
    "goods_applicable": (
        lambda t: s.applicable(t["shipment"].join(t["codes"].select("hs_code", F.col("p_partkey").alias("id")), "hs_code").select("query_id", "origin", "destination", "id"), t["rules"]).select("query_id", "id"),
        "SELECT query_id, p_partkey AS id FROM shipment JOIN codes USING (hs_code) WHERE EXISTS (SELECT 1 FROM rules WHERE id = p_partkey AND active AND (rule_origin IS NULL OR rule_origin = origin) AND (rule_destination IS NULL OR rule_destination = destination))"),
    "goods_effective": (
        lambda t: t["goods"].where(effective(F.col("valid_from"), F.col("valid_to"), F.lit(DAY))).groupBy("source").agg(F.count("*").alias("n")),
        "SELECT source, count(*) AS n FROM goods WHERE (valid_from IS NULL OR valid_from <= DATE '1998-01-01') AND (valid_to IS NULL OR valid_to >= DATE '1998-01-01') GROUP BY 1"),
    "dense_topk": (lambda t: _dense(t).select("query_id", "hs_code", "pos", F.round("similarity", 6).alias("similarity")), _DENSE + "SELECT query_id, hs_code, pos, round(s, 6) AS similarity FROM k"),
    "dense_with_training": (
        lambda t: _dense_taught(t).select("query_id", "hs_code", "pos", F.round("dense_similarity", 6).alias("dense_similarity"), F.round("dense_via_training", 6).alias("dense_via_training")),
        _DENSE + """, c AS (SELECT query_id, hs_code, s FROM k), x AS (SELECT query_id, hs_code - hs_code % 4 AS hs_code, max(s) AS t FROM k GROUP BY ALL)
        SELECT query_id, hs_code, row_number() OVER (PARTITION BY query_id ORDER BY c.s IS NULL, coalesce(c.s, t) DESC, hs_code) - 1 AS pos, round(coalesce(c.s, 0.95::DOUBLE * t), 6) AS dense_similarity, round(coalesce(t, 0), 6) AS dense_via_training FROM c FULL JOIN x USING (query_id, hs_code)"""),
    "sparse_topk_and": (lambda t: _sparse(t).select("query_id", "p_partkey", "pos", F.round("sparse_score", 6).alias("sparse_score")), _SPARSE),
    "sparse_with_training": (lambda t: _taught(t).select("query_id", "hs_code", F.round("sparse_score", 6).alias("sparse_score")), _TAUGHT),
    "entity_topk": (lambda t: r.entity_topk(*_entities(t)).select("query_id", "hs_code", "pos", F.round("entity_overlap_score", 6).alias("entity_overlap_score")), _ENTITY),
    "rrf_union": (lambda t: r.union(_branches(t)).select("query_id", "hs_code", "dense_similarity", "sparse_score", "entity_overlap_score", F.round("rrf_score", 9).alias("rrf_score")), _UNION + " SELECT query_id, hs_code, d AS dense_similarity, s AS sparse_score, e AS entity_overlap_score, round(rrf, 9) AS rrf_score FROM un"),
    "max_union": (lambda t: r.union(_branches(t), mode="max").select("query_id", "hs_code", "retrieval_score", "rrf_score"), _UNION + " SELECT query_id, hs_code, greatest(d, s, e) AS retrieval_score, 0.0::DOUBLE AS rrf_score FROM un"),
    "dynamic_head": (lambda t: r.dynamic_head(r.union(_branches(t)), 2, 4).select("query_id", "hs_code", "pos", "in_head"), _FUSED + "SELECT query_id, hs_code, pos, in_head FROM hd"),
    "linear_fusion": (lambda t: _ranked(t).select("query_id", "hs_code", "place", "score"), _FUSED + "SELECT query_id, hs_code, place, score FROM pl"),
    "chapter_prior": (lambda t: _ranked(t).select("query_id", "hs_code", F.round("chapter_prior", 6).alias("chapter_prior"), F.round("top1_minus_top2_gap", 6).alias("gap"), "ce_was_evaluated"), _FUSED + "SELECT query_id, hs_code, round(prior, 6) AS chapter_prior, round(g, 6) AS gap, in_head::INT::DOUBLE AS ce_was_evaluated FROM ft"),
    "confidence_metrics": (lambda t: _confidence(t).drop("chapter_distribution"), _CONF + "SELECT cf.*, chapter_consensus FROM cf JOIN cs USING (query_id)"),
    "chapter_distribution": (lambda t: r.confidence(_ranked(t)).select("query_id", F.explode("chapter_distribution").alias("chapter", "share")), _CONF + "SELECT query_id, chapter, round(share::VARCHAR::DECIMAL(38, 18), 4)::DOUBLE AS share FROM ch"),
    "abstention": (
        _abstained, _CONF + """, a AS (SELECT o_orderkey AS query_id, cf.top_code, top1_score IS NULL AS none, top1_score < 0.5 AS low, top1_minus_top2 < 0.02 AND chapter_consensus < 0.6 AS unclear, chapter_consensus FROM orders LEFT JOIN cf ON cf.query_id = o_orderkey LEFT JOIN cs ON cs.query_id = o_orderkey),
        b AS (SELECT *, CASE WHEN none THEN NULL WHEN low THEN CASE WHEN chapter_consensus >= 0.6 THEN 4 ELSE 2 END WHEN unclear THEN 2 END AS fallback_level FROM a)
        SELECT query_id, none OR low OR unclear AS abstained, CASE WHEN none THEN 'no_candidates' WHEN low THEN 'low_top1' WHEN unclear THEN 'ambiguous_chapter' END AS abstain_reason, fallback_level, substring(top_code, 1, fallback_level) AS fallback_code FROM b"""),
    "fallback_candidate": (
        lambda t: t["taxonomy"].select("hs_code", *(r.fallback_code(F.col("hs_code"), F.lit(n)).alias(f"at{n}") for n in (2, 4, 6))),
        "SELECT hs_code, substring(hs_code, 1, 2) AS at2, CASE WHEN length(hs_code) >= 4 THEN substring(hs_code, 1, 4) ELSE hs_code END AS at4, hs_code AS at6 FROM taxonomy"),
    "sanctions_rrf": (_merged, _merged_sql("rrf")),
    "sanctions_max": (lambda t: _merged(t, "max"), _merged_sql("max")),
    "alias_match": (_aliases, _ALIASES),
    "sanctions_dense": (_dense_goods, _DENSE_GOODS),
    "sanctions_sparse": (_sparse_goods, _SPARSE_GOODS),
    "rule_scores": (
        lambda t: _rule_matches(t).select("query_id", "rule_id", "mode", "phrase_similarity", "delta_above_threshold", "conditions_satisfied"),
        _RULES + "SELECT query_id, rule_id, mode, phrase_similarity, round(phrase_similarity - threshold::DOUBLE, 4) AS delta_above_threshold, conditions_satisfied FROM rs"),
    "rule_grouping": (
        lambda t: s.group_by_list(_rule_matches(t)),
        _RULES + """SELECT query_id, substring(created_by, 21) AS list, arg_max(phrase, (phrase_similarity, -rule_id)) AS top_phrase, max(phrase_similarity) AS top_similarity,
        count(*) FILTER (conditions_satisfied AND phrase_similarity >= threshold) AS n_above_threshold, count(*) AS n_total FROM rs WHERE created_by LIKE 'sanctions_source:KW:%' GROUP BY ALL"""),
    "draft_rule_test": (_draft_test, f"SELECT hs_code, round(1 / (1 + exp(-{logit_sql(chr(39) + 'large brushed steel box' + chr(39), 'description')})), 4) AS similarity FROM taxonomy WHERE level = 6"),
}
