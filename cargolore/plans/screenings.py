"""Queries of entities, versions, and whole screenings (§2.10, §2.11, §3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolore.functions.predicates import CONDITIONS
from cargolore.functions.text import STOP_WORDS
from cargolore.operators import entities, screen
from cargolore.operators.dashboards import run_plan
from cargolore.operators.fulltext import cover_density
from cargolore.plans.tables import Tables

def _spans_sql(texts: str) -> str:
    """Spans of the gazetteer's terms in ``texts`` (``id, t``): every term at every word, then
    a reader's way from left to right, then the best of equal terms."""
    words = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"""WITH RECURSIVE tx AS (SELECT id, lower(t) AS t, {words.format("t")} AS w FROM ({texts})),
ts AS (SELECT *, list_filter(range(1, length(t) + 1), lambda p: regexp_matches(substring(t, p, 1), '[a-z0-9]') AND NOT (p > 1 AND regexp_matches(substring(t, p - 1, 1), '[a-z0-9]'))) AS st FROM tx),
gz AS (SELECT label, array_to_string({words.format("term")}, ' ') AS term, max(score) AS score FROM gazetteer WHERE score >= 0.4 GROUP BY ALL),
mt AS MATERIALIZED (SELECT id, label, term, score, i, i + k - 1 AS j, st[i] - 1 AS start FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM ts) AS x, range(1, 7) AS y(k) JOIN gz ON term = array_to_string(w[i:i + k - 1], ' ') WHERE i + k - 1 <= len(w)),
lm AS (SELECT DISTINCT id, label, NULL::VARCHAR AS term, NULL::DOUBLE AS score, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS start FROM mt
  UNION ALL SELECT m.id, m.label, m.term, m.score, m.i, m.j, m.start FROM lm JOIN mt AS m ON m.id = lm.id AND m.label = lm.label AND m.i > lm.j
  QUALIFY row_number() OVER (PARTITION BY m.id, m.label ORDER BY m.i, m.j DESC) = 1),
sp AS (SELECT * FROM lm WHERE term IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, label, term ORDER BY score DESC, start) = 1)
"""


_SPOKEN = "SELECT p_partkey AS id, p_type || ', ' || p_name || '/' || p_type || ' ' || p_brand || ' (' || p_name || ')' AS t FROM part"
_TITLED = "SELECT hs_code AS id, title || ' ' || description AS t FROM taxonomy"


def _spans(t: Tables) -> DataFrame:
    text = F.concat("p_type", F.lit(", "), "p_name", F.lit("/"), "p_type", F.lit(" "), "p_brand", F.lit(" ("), "p_name", F.lit(")"))
    spans = entities.distinct_spans(t["part"].select(F.col("p_partkey").alias("query_id"), text.alias("text")), t["gazetteer"])
    return spans.select("query_id", "label", "text", F.col("start").cast("long").alias("start"), "score", F.lower("surface").alias("surface"))


def _index(t: Tables) -> DataFrame:
    return entities.entity_index(t["taxonomy"], t["gazetteer"])


def _flattened(t: Tables) -> DataFrame:
    """Entities as they are kept: a text, an object, an object without a text."""
    kept = F.concat(
        F.lit('{"material": ["'), "p_name", F.lit('", {"text": "'), "p_type", F.lit('", "start": 3, "score": 0.5}], "form": [{"start": 1}], "'), "p_brand", F.lit('": [{"text": "Größe '), "p_size", F.lit('"}]}'),
    )
    flat = t["part"].select("p_partkey", F.explode(entities.flatten_entities(kept)).alias("label", "texts"))
    return flat.select("p_partkey", "label", F.array_join("texts", "|").alias("texts"))


def _stamp(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.explode(screen.version_stamp(t["run"], "abc", ltr="none")).alias("k", "v"))


def _cover(t: Tables) -> DataFrame:
    tokens = F.split(F.lower("text"), "[^a-z0-9]+")
    return t["benchmark"].select("item_id", F.round(cover_density(tokens, F.array(F.lit("the"))), 6).alias("one"), F.round(cover_density(tokens, F.array(F.lit("the"), F.lit("of"))), 6).alias("two"))


def _embedded(t: Tables) -> DataFrame:
    """The components that are not zero."""
    v = t["taxonomy"].select("hs_code", F.posexplode(entities.embed(F.col("description"), 64)).alias("i", "x"))
    return v.where("x <> 0").select("hs_code", "i", F.round("x", 6).alias("x"))


_HASHED = f"""WITH w AS (SELECT hs_code, unnest(string_split_regex(lower(description), '[^a-z0-9]+')) AS w FROM taxonomy),
s AS (SELECT hs_code, ('0x' || substring(md5(w), 1, 8))::BIGINT % 64 AS i, sum(1 - 2 * (('0x' || substring(md5(w), 9, 8))::BIGINT % 2)) AS x
  FROM w WHERE w <> '' AND w NOT IN ({", ".join(f"'{w}'" for w in sorted(STOP_WORDS))}) GROUP BY ALL),
n AS (SELECT hs_code, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1)
SELECT hs_code, i::INT AS i, round(x / norm, 6)::DOUBLE AS x FROM s JOIN n USING (hs_code) WHERE x <> 0"""


def catalogue(t: Tables) -> DataFrame:
    """Each part as a shipment on one route; every third names a second material."""
    route = t["part"].join(t["iso"].select((F.col("n_nationkey")).alias("__o"), F.col("iso").alias("origin")), F.col("p_partkey") % 25 == F.col("__o"))
    route = route.join(t["iso"].select(F.col("n_nationkey").alias("__d"), F.col("iso").alias("destination")), (F.col("p_partkey") * 3) % 25 == F.col("__d"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("; large "), "p_type")).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    return route.select(F.col("p_partkey").cast("string").alias("query_id"), text.alias("text"), "origin", "destination", F.col("p_retailprice").alias("value"), F.lit("USD").alias("currency"), F.lit(None).cast("map<string,string>").alias("metadata"))


def _screened(t: Tables) -> DataFrame:
    conditions = F.struct("min_value", F.lit(None).cast("double").alias("max_value"), F.when(F.col("only_currency").isNotNull(), F.array("only_currency")).alias("currency_in"), F.lit(None).cast("map<string,string>").alias("metadata_eq"))
    rules = t["screening"].withColumns({"conditions": conditions.cast(f"struct<{CONDITIONS.replace(' ', ':').replace(',:', ',')}>"), "phrase_group": F.struct("mode", F.col("group_phrases").alias("phrases"))}).drop("mode")
    return screen.screen(catalogue(t), t["taxonomy"], t["goods"], t["rules"], rules, t["gazetteer"], on=dt.date(1998, 1, 1), versions=screen.version_stamp())


_MATERIALS = ("steel", "brass", "copper", "red", "blue", "green", "small", "large", "economy", "standard", "promo")


def _multi(t: Tables) -> DataFrame:
    return screen.split_goods(catalogue(t), F.array(*map(F.lit, _MATERIALS))).select("parent_id", "fragment", "text")


def _plan(t: Tables) -> DataFrame:
    rows = t["nation"].select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("source"), (F.col("n_nationkey") % 4 != 1).alias("has_files"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat(F.lit("s"), (F.col("n_nationkey") + 1).cast("string")))).otherwise(F.array().cast("array<string>")).alias("needs"), (F.col("n_nationkey") % 3).cast("long").alias("n_rows"))
    return run_plan(rows)


QUERIES = {
    "extract_entities": (
        _spans,
        _spans_sql(_SPOKEN) + """SELECT sp.id AS query_id, label, term AS text, start, score, substring(t, start + 1, st[j] + length(w[j]) - 1 - start) AS surface FROM sp JOIN ts USING (id)"""),
    "entity_index": (
        _index,
        _spans_sql(_TITLED) + "SELECT DISTINCT id AS hs_code, label AS entity_type, term AS entity_value, CASE label WHEN 'material' THEN 1.0::DOUBLE WHEN 'form' THEN 0.8 ELSE 0.9 END AS weight FROM sp"),
    "flatten_entities": (
        _flattened,
        """SELECT p_partkey, 'material' AS label, p_name || '|' || lower(p_type) AS texts FROM part UNION ALL SELECT p_partkey, 'form', '' FROM part
        UNION ALL SELECT p_partkey, p_brand, 'größe ' || p_size FROM part"""),
    "version_stamp": (
        _stamp, "SELECT 'engine' AS k, 'cargolore-1' AS v UNION ALL SELECT 'policy', 'abc' UNION ALL SELECT 'ltr', 'none' UNION ALL SELECT 'refdata.' || source, strftime(max(finished_at), '%Y-%m-%dT%H:%M:%S') FROM run WHERE status = 'success' GROUP BY source"),
    "cover_density": (
        _cover,
        """WITH t AS (SELECT item_id, string_split_regex(lower(text), '[^a-z0-9]+') AS w FROM benchmark), p AS (SELECT item_id, i, w[i] AS w FROM t, unnest(range(1, len(w) + 1)) AS u(i) WHERE w[i] IN ('the', 'of')),
        n AS (SELECT *, lead(i) OVER x AS j, lead(w) OVER x AS v FROM p WINDOW x AS (PARTITION BY item_id ORDER BY i))
        SELECT item_id, round(coalesce((SELECT count(*) FROM p WHERE p.item_id = t.item_id AND w = 'the'), 0) * 0.1::DOUBLE, 6) AS one, round(coalesce((SELECT sum(0.1::DOUBLE / (j - i)) FROM n WHERE n.item_id = t.item_id AND v <> w), 0), 6) AS two FROM t"""),
    "hashed_embedding": (_embedded, _HASHED),
    "run_plan": (
        _plan,
        """SELECT 's' || n.n_nationkey AS source, CASE WHEN n.n_nationkey % 4 = 1 THEN 'no_files' WHEN n.n_nationkey % 2 = 0 AND coalesce(o.n_nationkey % 3, 0) <= 0 THEN 'dependency_empty' ELSE 'run' END AS action
        FROM nation AS n LEFT JOIN nation AS o ON o.n_nationkey = n.n_nationkey + 1"""),
    "multi_commodity": (
        _multi,
        f"""WITH f AS (SELECT p_partkey::VARCHAR AS parent_id, [p_name, 'large ' || p_type] AS f FROM part WHERE p_partkey % 3 = 0 AND length(p_name) >= 5),
        m AS (SELECT *, list_transform(f, lambda x: list_filter([{", ".join(f"'{m}'" for m in _MATERIALS)}], lambda y: contains(lower(x), y))) AS m FROM f),
        s AS (SELECT *, list_filter([1, 2], lambda i: len(m[i]) > 0) AS held FROM m WHERE len(list_distinct(flatten(m))) >= 2)
        SELECT parent_id, (i - 1)::INT AS fragment, f[i] AS text FROM (SELECT *, unnest([1, 2]) AS i FROM s WHERE len(held) = 2)"""),
    "screen_shipments": (_screened, None),
}
