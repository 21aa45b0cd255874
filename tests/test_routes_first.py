"""The sanction paths against SQL in the reference's order: routes, then order, then limit."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from cargolore.plans.tables import sql
from cargolore.plans.texts import covers_sql
from test_queries import FOLDER, duck, plain  # noqa: F401

ROUTE = "chr((65 + ({k} % 25) % 26)::INT) || chr((65 + (({k} % 25) * 7) % 26)::INT)"
COVERED = f"""EXISTS (SELECT 1 FROM rules AS r WHERE r.id = g.id AND active AND (rule_origin IS NULL OR rule_origin = {ROUTE.format(k="g.query_id")})
AND (rule_destination IS NULL OR rule_destination = {ROUTE.format(k="(g.query_id * 3)")}))"""
WHOLE = {
    "sanctions_dense": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    g AS (SELECT a.vec_id AS query_id, b.vec_id * 5 AS id, list_cosine_similarity(a.e, b.e) AS s FROM v AS a, v AS b WHERE a.vec_id % 20 = 0)
    SELECT query_id, id, round(s, 6) AS similarity FROM g WHERE {COVERED} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 10""",
    "sanctions_sparse": f"""WITH {covers_sql("SELECT p_name AS text, min(p_partkey) AS query_id FROM part GROUP BY 1", "SELECT p_partkey AS key, description || ' of the ' || p_size || ' ' || title AS text FROM codes", "simple")},
    g AS (SELECT query_id, key AS id, rank FROM rk)
    SELECT query_id, id, rank AS similarity FROM g WHERE {COVERED} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id) <= 20""",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_routes_come_before_the_limit(spark, duck, name):  # noqa: F811
    got, want = contract.queries()[name](spark, FOLDER).toPandas(), duck.sql(sql(WHOLE[name])).df()
    assert plain(got[["query_id", "id", "similarity"]]) == plain(want)
