"""Exact vector search over cells against all pairs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cargolore.operators import retrieval, vectors


def tables(spark, n, asked, seed=0, spread=0.15):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(12, 8))
    rows = [(f"c{i:04d}", (middle[i % 12] + spread * r.normal(size=8)).tolist(), [f"k{i % 3}"]) for i in range(n)]
    rows += [(f"d{i:03d}", rows[0][1], ["k0", "k1"]) for i in range(60)]  # equal rows
    rows += [("zero", [0.0] * 8, ["k0"]), ("null", None, ["k0"]), ("gap", [None] + [1.0] * 7, ["k0"]), ("nan", [float("nan")] * 8, ["k0"]), ("short", [1.0, 2.0], ["k0"]), ("empty", [], ["k0"])]
    queries = [(i, (middle[i % 12] + spread * r.normal(size=8)).tolist(), [f"k{i % 4}"] if i % 5 else None) for i in range(asked)]
    queries += [(9000, [3.0, 1.0], ["k0"]), (9001, [0.0] * 8, ["k0"]), (9002, rows[0][1], ["k0", "k2"]), (9003, None, None)]
    return rows, queries, spark.createDataFrame(rows, "hs_code string, v array<double>, on array<string>"), spark.createDataFrame(queries, "query_id int, q array<double>, of array<string>")


def all_pairs(rows, queries, k, among):
    ok = lambda v: v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)
    out = {}
    for q, x, of in queries:
        hits = []
        for c, v, on in rows:
            if ok(x) and ok(v) and len(x) == len(v) and (not among or set(of or []) & set(on)):
                hits.append((-round(float(np.dot(x, v) / np.linalg.norm(x) / np.linalg.norm(v)), 11), c))
        if hits:
            out[q] = [c for _, c in sorted(hits)[:k]]
    return out


@pytest.mark.parametrize(("k", "among"), [(5, None), (5, ("of", "on")), (70, None)])
def test_nearest_is_exact(spark, monkeypatch, k, among):
    monkeypatch.setattr(vectors, "CELL_ROWS", 25)
    monkeypatch.setattr(vectors, "TILE_ROWS", 16)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 7)
    rows, queries, corpus, asked = tables(spark, 500, 60)
    got = {}
    for r in retrieval.dense_topk(asked, corpus, k, among).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.hs_code)
    assert got == all_pairs(rows, queries, k, among)


def test_cells_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 25)
    seen = []
    plain = vectors._others

    def counted(*a):
        out = plain(*a)
        seen.append(out.count())
        return out

    monkeypatch.setattr(vectors, "_others", counted)
    _, _, corpus, asked = tables(spark, 2000, 100, spread=0.02)
    retrieval.dense_topk(asked, corpus, 3).count()
    assert seen[0] < 100 * 40  # of about 80 other cells


def test_no_query_reaches_the_driver(spark, monkeypatch):
    """Many queries on few rows: what is collected are cells, and no plan multiplies with the queries."""
    r = np.random.default_rng(1)
    asked = spark.range(60_000).select(F.col("id").alias("query_id"), F.array(*(F.sin((F.col("id") + 1) * (i + 1)) for i in range(4))).alias("q"))
    corpus = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(50)], "hs_code int, v array<double>")
    most = []
    plain = type(asked).collect
    monkeypatch.setattr(type(asked), "collect", lambda self: most.append(len(out := plain(self))) or out)
    found = retrieval.dense_topk(asked, corpus, 3)
    assert max(most) <= 50 and "Cartesian" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    assert found.count() == 180_000


@pytest.mark.parametrize("k", [3, 70])
def test_queries_are_compared_in_strips(spark, monkeypatch, k):
    monkeypatch.setattr(vectors, "STRIP_QUERIES", 3)
    rows, queries, corpus, asked = tables(spark, 300, 30)
    got = {}
    for r in retrieval.dense_topk(asked, corpus, k, ("of", "on")).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.hs_code)
    assert got == all_pairs(rows, queries, k, ("of", "on"))


def test_a_tile_takes_no_memory_by_pairs():
    unit = vectors.unit_rows(np.random.default_rng(1).normal(size=(6144, 16)))[0]
    asks = np.arange(6144) < 2048
    ids = [pa.array([i if a == own else None for i, a in enumerate(asks)], pa.int64()) for own in (True, False)]
    table = pa.table({"asks": asks, "query_id": ids[0], "hs_code": ids[1], "keys": pa.nulls(6144, pa.list_(pa.string())), "u": pa.array(list(unit), pa.list_(pa.float64()))})
    tracemalloc.start()
    found = vectors._tile(10, (pa.int64(), pa.int64()), False)(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 20480 and most < 64e6  # all pairs are 67 MB, and were held more than once
