"""Centroid clustering and exact search against plain versions in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from cargolore.llm import centroid_clustering as clustering
from cargolore.llm import exact_search as search

SCHEMA = "vec_id long, embedding array<double>, label int, x string, e string, row string, code int, cluster string, shard int, n int"


def vectors(seed, n, dim=64):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(6, dim)) * 0.2
    rows = [(i, [float(v) for v in middle[i % 6] + r.normal(size=dim) * 0.05]) for i in range(n)]
    rows += [rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (n + 1, rows[4][1]), (n + 2, [0.0] * dim), (n + 3, [-v for v in rows[5][1]])]
    odd = [(n + 4, None), (n + 5, [float("nan")] * dim), (n + 6, [float("inf")] + [0.0] * (dim - 1)), (n + 7, [None] + [0.1] * (dim - 1)), (n + 8, []), (100, [0.5] * 3), (n + 9, [0.25] * 3)]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", "e", "r", 1, "c", 1, 1) for r in rows], SCHEMA).repartition(3)


def usable(e):
    return e is not None and all(v is not None and math.isfinite(v) for v in e)


# op12


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, tuple(math.floor(256 * v) for v in e)) for i, e in rows if usable(e) and len(e) == 64]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~", x) for i, x in kept)
    centroids = [x for _, x in named[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        parts = {}
        for _, x in kept:
            parts.setdefault(near(x)[1], []).append(x)
        for j, own in parts.items():
            centroids[j] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    found = [(i, near(x)) for i, x in kept]
    inertia = [sum(d for _, (d, j) in found if j == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), j, d, inertia[j], sum(inertia), digest[j]) for i, (d, j) in found)


@pytest.mark.parametrize("n", [150, 10])
def test_clusters(spark, tmp_path, n):
    rows = vectors(n, n)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in clustering.query(spark, str(tmp_path)).collect())
    assert got == plain_clusters(rows)


@pytest.mark.parametrize("scale", [3, 300, 10**6])
def test_bounds_are_below_distances_and_prune(scale):
    r = np.random.default_rng(scale)
    middle = r.normal(size=(40, 21)) * scale
    x = np.floor(middle[r.integers(0, 40, 500)] + r.normal(size=(500, 21)) * scale / 9).astype(np.int64)
    centroids = np.floor(middle).astype(np.int64)
    code, shift, norms = clustering.compress(x)
    assert code.max() < 1 << clustering.BITS
    least = clustering.bounds(code.astype(np.int64) - 8, shift, norms, (x**2).sum(1).astype(float), centroids)
    exact = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (least <= exact).all()
    at, d, measured = clustering.nearest(x, least, centroids)
    assert (at == exact.argmin(1)).all() and (d == exact.min(1)).all()
    assert scale == 3 or measured < 5 * len(x)


def test_equal_centroids_take_the_smaller_number():
    x = np.zeros((3, 8), np.int64)
    centroids = np.array([[5] * 8, [0] * 8, [0] * 8])
    code, shift, norms = clustering.compress(x)
    least = clustering.bounds(code.astype(np.int64) - 8, shift, norms, np.zeros(3), centroids)
    assert clustering.nearest(x, least, centroids)[0].tolist() == [1, 1, 1]


def test_clusters_of_nothing(spark, tmp_path):
    frame(spark, [(1, [0.1] * 3), (2, None), (3, [1e9] * 64)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert clustering.query(spark, str(tmp_path)).count() == 0


def test_odd_lengths_and_segments(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i).normal(size=11)]) for i in range(60)]
    found, centroids = clustering.cluster(frame(spark, rows), k=3, rounds=2, dim=11)
    assert found.count() == 60 and centroids.agg({"n": "sum"}).first()[0] == 60 and centroids.count() == 3


# op13


def plain_search(rows, k=10):
    kept = [(n, i, [math.floor(1024 * v) for v in e]) for n, (i, e) in enumerate(rows) if usable(e)]
    out = []
    for n, i, q in kept:
        if i is not None and i % 100 == 0:
            ranked = sorted(
                (-sum(a * b for a, b in zip(q, c, strict=True)), j is None, j or 0)
                for m, j, c in kept if m != n and len(c) == len(q)
            )
            out += [(i, at, None if unnamed else j, -s) for at, (s, unnamed, j) in enumerate(ranked[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize(("block", "shard"), [(4096, 1024), (2, 9), (1, 1000)])
def test_search(spark, block, shard):
    from pyspark.sql import functions as F

    rows = vectors(3, 230)
    rows += [(200, rows[200][1]), (200, rows[7][1])] + [(1000 + i, rows[100][1]) for i in range(25)]
    random.Random(1).shuffle(rows)
    got = search.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, block=block, shard=shard).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_search(rows)


def test_search_query_and_empty(spark, tmp_path):
    rows = vectors(4, 120)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(str(tuple(r)) for r in search.query(spark, str(tmp_path)).collect()) == plain_search(rows)
    frame(spark, rows).where("false").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert search.query(spark, f"{tmp_path}/none").count() == 0


def test_products_of_large_numbers():
    a, b = np.array([[1e15, -3.5], [1e300, 0.0]]), np.array([[2e15, 0.25], [-1e300, 1.0]])
    whole = lambda v: int(v) * 1024 if abs(v) >= 2**53 else math.floor(1024 * v)
    for i, x in enumerate(search.products(a, b, 1024)):
        for j, y in enumerate(x):
            exact = sum(whole(float(p)) * whole(float(q)) for p, q in zip(a[i], b[j], strict=True))
            assert y == max(-(2**63) + 1, min(2**63 - 1, exact))


def test_selection_keeps_the_first_of_equal_scores():
    scores = np.array([5, 7, 7, 5, 7, 5, 5])
    assert search.select(scores, 4).tolist() == [1, 2, 4, 0]
    assert search.select(scores, 9).tolist() == [1, 2, 4, 0, 3, 5, 6]
