"""Domain relations derived from the driver tables.

Each derivation is one SQL text that Spark and the comparison engine read alike
(``ARRAY(`` is the one word that is exchanged), so a query and its SQL start
from the same rows and differ in all that comes after.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DERIVED = {
    "iso": "SELECT n_nationkey, chr(CAST(65 + n_nationkey % 26 AS INT)) || chr(CAST(65 + (n_nationkey * 7) % 26 AS INT)) AS iso FROM nation",
    "codes": """
        SELECT p_partkey, lpad(CAST(1 + p_partkey % 97 AS STRING), 2, '0') || lpad(CAST(p_partkey % 89 AS STRING), 2, '0') || lpad(CAST(p_partkey % 83 AS STRING), 2, '0') AS hs_code,
               p_name AS title, p_name || ' ' || p_type || ' ' || p_brand AS description, p_size, p_retailprice FROM part""",
    "taxonomy": """
        SELECT hs_code, 6 AS level, substring(hs_code, 1, 2) AS chapter, substring(hs_code, 1, 4) AS parent_code, min(title) AS title, min(description) AS description FROM codes GROUP BY hs_code
        UNION ALL SELECT substring(hs_code, 1, 4), 4, substring(hs_code, 1, 2), substring(hs_code, 1, 2), min(title), min(description) FROM codes GROUP BY 1, 2, 3, 4
        UNION ALL SELECT substring(hs_code, 1, 2), 2, substring(hs_code, 1, 2), NULL, min(title), min(description) FROM codes GROUP BY 1, 2, 3""",
    "shipment": """
        SELECT l_orderkey * 10 + l_linenumber AS query_id, l_orderkey, p_name || ' ' || p_type AS text, c.hs_code,
               CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE f.iso END AS origin, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE t.iso END AS destination,
               l_extendedprice AS value, CASE l_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'CHF' END AS currency, o_orderdate AS created_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
             JOIN part ON l_partkey = part.p_partkey JOIN codes AS c ON c.p_partkey = l_partkey JOIN iso AS f ON f.n_nationkey = s_nationkey JOIN iso AS t ON t.n_nationkey = c_nationkey""",
    "goods": """
        SELECT p_partkey AS id, CASE p_partkey % 20 WHEN 0 THEN 'EU' WHEN 5 THEN 'BIS' WHEN 10 THEN 'KW:metals' ELSE 'KW:foods' END AS source, 'R' || CAST(p_partkey AS STRING) AS source_record_id,
               description, ARRAY(hs_code) AS hs_codes, 'blocked' AS restriction_type, CAST(NULL AS STRING) AS provenance_url,
               CASE p_partkey % 3 WHEN 0 THEN DATE '1993-01-01' WHEN 1 THEN DATE '1996-06-01' ELSE NULL END AS valid_from,
               CASE p_partkey % 7 WHEN 0 THEN DATE '1997-01-01' WHEN 1 THEN DATE '2030-01-01' ELSE NULL END AS valid_to,
               TIMESTAMP '2020-01-01 00:00:00' AS sys_from, CASE WHEN p_partkey % 9 = 0 THEN TIMESTAMP '2021-01-01 00:00:00' ELSE NULL END AS sys_to
        FROM codes WHERE p_partkey % 5 = 0""",
    "rules": """
        SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE f.iso END AS rule_origin, CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE t.iso END AS rule_destination,
               CASE WHEN p_partkey % 2 = 0 THEN 'blocked' ELSE 'license' END AS restriction_type, p_partkey % 8 <> 0 AS active
        FROM part JOIN iso AS f ON f.n_nationkey = p_partkey % 25 JOIN iso AS t ON t.n_nationkey = (p_partkey * 3) % 25 WHERE p_partkey % 5 = 0
        UNION ALL SELECT p_partkey, f.iso, NULL, 'license', TRUE FROM part JOIN iso AS f ON f.n_nationkey = (p_partkey * 7) % 25 WHERE p_partkey % 10 = 0""",
    "screening": """
        SELECT p_partkey AS rule_id, 'rule ' || CAST(p_partkey % 40 AS STRING) AS name, CAST(1 + (p_partkey - p_partkey % 40) / 40 AS INT) AS version, p_name AS phrase, CASE p_partkey % 3 WHEN 0 THEN 'any_of' WHEN 1 THEN 'all_of' ELSE 'odd' END AS mode,
               CASE WHEN p_partkey % 2 = 0 THEN ARRAY(p_name, p_type) ELSE NULL END AS group_phrases, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE f.iso END AS rule_origin, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE t.iso END AS rule_destination,
               0.3 + (p_partkey % 5) * 0.1 AS threshold, p_partkey % 6 <> 0 AS active, CASE WHEN p_partkey % 5 = 0 THEN 'analyst' WHEN p_partkey % 5 = 1 THEN 'sanctions_source:EU' ELSE 'sanctions_source:KW:' || substring(p_type, 1, 5) END AS created_by,
               CASE WHEN p_partkey % 3 = 1 THEN CAST(20000 AS DOUBLE) ELSE NULL END AS min_value, CASE WHEN p_partkey % 4 = 1 THEN 'EUR' ELSE NULL END AS only_currency
        FROM (SELECT p_name, min(p_partkey) AS p_partkey, min(p_type) AS p_type FROM part GROUP BY p_name) AS named JOIN iso AS f ON f.n_nationkey = p_partkey % 25 JOIN iso AS t ON t.n_nationkey = (p_partkey * 11) % 25""",
    "gazetteer": """
        SELECT DISTINCT 'material' AS label, substring(p_name, 1, instr(p_name, ' ') - 1) AS term, CAST(0.9 AS DOUBLE) AS score FROM part
        UNION ALL SELECT DISTINCT 'material', p_name, CAST(0.95 AS DOUBLE) FROM part
        UNION ALL SELECT DISTINCT 'form', p_type, CAST(0.8 AS DOUBLE) FROM part
        UNION ALL SELECT DISTINCT 'form', substring(p_name, instr(p_name, ' ') + 1) || ' -- ' || lower(p_type), CAST(0.7 AS DOUBLE) FROM part
        UNION ALL SELECT DISTINCT 'end_use', p_type || ' ' || p_brand, CAST(0.6 AS DOUBLE) FROM part
        UNION ALL SELECT DISTINCT 'end_use', p_name || ', ' || p_type || '/' || p_brand, CAST(0.5 AS DOUBLE) FROM part
        UNION ALL SELECT DISTINCT 'dimensions', p_brand, CAST(0.3 AS DOUBLE) FROM part""",
    "result": """
        SELECT o_orderkey AS result_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE f.iso END AS origin, t.iso AS destination,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 4 = 0 END AS abstained
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN iso AS t ON t.n_nationkey = c_nationkey JOIN iso AS f ON f.n_nationkey = o_custkey % 25""",
    "candidate": """
        SELECT l_orderkey AS result_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS line, c.hs_code, substring(c.hs_code, 1, 2) AS chapter, (l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 101 / CAST(100 AS DOUBLE) AS score
        FROM lineitem JOIN codes AS c ON c.p_partkey = l_partkey WHERE l_orderkey % 7 <> 0""",
    "match": """
        SELECT l_orderkey AS result_id, g.source, round((l_partkey % 50 + l_linenumber) / CAST(60 AS DOUBLE), 4) AS similarity FROM lineitem JOIN goods AS g ON g.id = l_partkey""",
    "hit": """
        SELECT l_orderkey AS result_id, l_suppkey AS rule_id, round((l_suppkey % 21 - 10) / CAST(20 AS DOUBLE), 4) AS delta FROM lineitem WHERE l_linenumber <= 2 AND l_suppkey % 3 = 0""",
    "feedback": """
        SELECT event_id, user_id AS result_id, CASE event_type WHEN 'purchase' THEN 'override' WHEN 'click' THEN 'override' ELSE 'confirm' END AS kind, ts FROM events""",
    "run": """
        SELECT event_id AS run_id, event_type AS source, CASE WHEN event_type = 'view' THEN 'taxonomy' ELSE 'sanctions' END AS kind, ts AS started_at, ts AS finished_at, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'success' END AS status FROM events""",
    "record": """
        SELECT doc_id AS id, quality = 1 AS correct, (doc_id * 37 % 1000) / CAST(1000 AS DOUBLE) AS score FROM labels""",
    "ranked": """
        SELECT l_orderkey AS query_id, l_linenumber AS place, c.hs_code FROM lineitem JOIN codes AS c ON c.p_partkey = l_partkey""",
    "branch": """
        SELECT l_orderkey AS query_id, c.hs_code, 0 AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos, (101 - l_partkey % 100) / CAST(127 AS DOUBLE) AS value FROM lineitem JOIN codes AS c ON c.p_partkey = l_partkey
        UNION ALL SELECT l_orderkey, c.hs_code, 1, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) - 1, (1 + l_suppkey % 64) / CAST(67 AS DOUBLE) FROM lineitem JOIN codes AS c ON c.p_partkey = l_partkey WHERE l_linenumber % 2 = 1
        UNION ALL SELECT l_orderkey, c.hs_code, 2, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1, (1 + l_linenumber % 8) / CAST(9 AS DOUBLE) FROM lineitem JOIN codes AS c ON c.p_partkey = l_partkey WHERE l_linenumber % 3 = 0""",
    "gold": """
        SELECT o_orderkey AS query_id, c.hs_code AS gold FROM orders JOIN codes AS c ON c.p_partkey = 1 + o_orderkey % 50""",
}


class Tables:
    """The driver tables and the derived relations under one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = DERIVED[name]
                own = [n for n in (*BASE, *DERIVED) if n != name and re.search(rf"(?:FROM|JOIN)\s+{n}\b", text)]
                marked = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(own)})\b(?!\s+AS\b)", r"\1 {\2} AS \2", text)
                marked = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(own)})\b", r"\1 {\2}", marked)
                self._made[name] = self.spark.sql(marked, **{n: self[n] for n in own})
        return self._made[name]


def sql(body: str) -> str:
    """A query over the driver tables and the derived relations that it may name, for DuckDB."""
    needed, words = set(), set(re.findall(r"\w+", body))
    while found := {n for n in DERIVED if n in words} - needed:
        needed |= found
        words = {w for n in found for w in re.findall(r"\w+", DERIVED[n])}
    views = ",\n".join(f'"{n}" AS ({t})' for n, t in DERIVED.items() if n in needed).replace("ARRAY(", "list_value(")
    if not views:
        return body
    head = re.match(r"\s*WITH( RECURSIVE)?\b", body)
    return f"WITH{head[1] or ''} {views},\n{body[head.end():]}" if head else f"WITH {views}\n{body}"
