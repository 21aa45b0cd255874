"""Centroid clustering in whole numbers, with block-norm screening.

A kept vector ``x`` has ``floor(scale * component)`` as its integers.  Stored of it,
once, beside them are

* its compressed form ``y``: a few bits for each component, the middle of the range
  that the bits leave;
* for each segment of ``SEGMENT`` components the norm of the rest ``x - y``.

By Cauchy and Schwarz, ``<x, c> <= <y, c> + sum(norm of the rest * norm of c)`` over
the segments, which bounds the squared distance ``|x|^2 + |c|^2 - 2 <x, c>`` to a
centroid ``c`` from below.  The centroid of least bound is measured exactly; only
centroids whose bound does not exceed that distance are measured besides, in 64-bit
integers.  Bounds are computed in double precision and lowered by more than its error,
so screening never changes a result.

Each round is one pass over the stored table.  A task adds up its vectors by centroid
and gives one row a centroid; these are summed on Spark, and the driver gets ``k`` sums,
whose size no input changes.

Defined cases: vectors that are null, of another length, or with null or non-finite
components are left out, as are those with a component of ``2^27 / scale`` or more,
whose distances need more than 64 bits; ids may repeat or be null: each row is a vector, and
a row of null id seeds a centroid only after all others; of rows with equal ids the
one with the smaller integers seeds first; fewer vectors than ``k`` give as many
centroids; an empty centroid stays as it is; extra columns are not read.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolore.llm.common import materialize

K = 40
ROUNDS = 5
SCALE = 256
DIM = 64
SEED = 2
#: Components in a segment, and bits of a compressed component.
SEGMENT = 8
BITS = 4
#: Integers of this size and more would need longer distances.
LARGEST = 2**27
#: Vectors screened at once in a task.
ROWS = 1024


def integers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of equally long integer lists as rows."""
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)


def segment_norms(rows: np.ndarray) -> np.ndarray:
    """The norm of each segment of each row, never too small."""
    wide = -(-rows.shape[1] // SEGMENT) * SEGMENT
    padded = np.zeros((len(rows), wide))
    padded[:, : rows.shape[1]] = rows
    return np.sqrt((padded.reshape(len(rows), -1, SEGMENT) ** 2).sum(2)) * (1 + 1e-12)


def compress(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of ``BITS`` bits, how far each row was shifted, and the norms of the rest."""
    half = 1 << (BITS - 1)
    most = np.maximum(x.max(1), -x.min(1) - 1)
    shift = np.zeros(len(x), np.int64)
    while (over := (most >> shift) >= half).any():
        shift += over
    code = x >> shift[:, None]
    return (code + half).astype(np.uint8), shift, segment_norms(x - decompress(code, shift))


def decompress(code: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The middle of what each signed code stands for."""
    return np.ldexp(code + 0.5, shift[:, None]) - 0.5


def bounds(code: np.ndarray, shift: np.ndarray, norms: np.ndarray, square: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances, one row a vector and one column a centroid."""
    c = centroids.astype(np.float64)
    left = np.concatenate([decompress(code, shift), norms], axis=1)
    product = left @ np.concatenate([c, segment_norms(c)], axis=1).T
    own = (c**2).sum(1)
    error = 1e-11 * (square[:, None] + own + 2 * np.abs(left) @ np.abs(np.concatenate([c, segment_norms(c)], axis=1)).T)
    return square[:, None] + own - 2 * product - error


def nearest(x: np.ndarray, least: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` its nearest centroid (the smaller number of equal ones),
    the squared distance, and how many distances were computed for all rows."""
    at = np.arange(len(x))
    first = least.argmin(1)
    best = ((x - centroids[first]) ** 2).sum(1)
    more = least <= best[:, None]
    more[at, first] = False
    i, j = np.nonzero(more)
    i, j = np.concatenate([at, i]), np.concatenate([first, j])
    d = np.concatenate([best, ((x[i[len(x) :]] - centroids[j[len(x) :]]) ** 2).sum(1)])
    order = np.lexsort((j, d, i))
    head = order[np.searchsorted(i[order], at)]
    return j[head], d[head], len(d)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    half = 1 << (BITS - 1)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            x = integers(part, "x")
            code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            code = np.stack([code >> 4, code & 15], axis=2).reshape(len(x), -1)[:, : x.shape[1]].astype(np.int64) - half
            norms = part.column("norms").flatten().to_numpy().reshape(len(x), -1)
            square = part.column("square").to_numpy().astype(np.float64)
            least = bounds(code, part.column("shift").to_numpy(), norms, square, centroids)
            yield part, x, *nearest(x, least, centroids)


def vector_table(vectors: DataFrame, *, dim: int = DIM, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Integers, codes, shifts, norms and squared length of every kept vector, written once."""
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    fits = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (v * scale >= -LARGEST) & (v * scale < LARGEST))
    whole = F.transform("e", lambda v: F.floor(v * scale).cast("int"))
    kept = named.where(F.coalesce((F.size("e") == dim) & fits, F.lit(False))).select("vec_id", whole.alias("x"))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = integers(batch, "x")
                code, shift, norms = compress(x)
                code = np.concatenate([code, np.zeros((len(x), code.shape[1] % 2), np.uint8)], axis=1)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id"), "x": batch.column("x"),
                    "code": pa.array([r.tobytes() for r in code[:, ::2] << 4 | code[:, 1::2]], pa.binary()),
                    "shift": pa.array(shift), "norms": pa.array(list(norms), pa.list_(pa.float64())), "square": pa.array((x**2).sum(1)),
                })

    table = kept.mapInArrow(stored, "vec_id bigint, x array<int>, code binary, shift bigint, norms array<double>, square bigint")
    return materialize(table, "cluster-vectors")


def assign(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance, measured`` of every stored vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance, measured in _assigned(batches, centroids):
            share = np.zeros(part.num_rows, np.int32)
            share[0] = measured
            yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id"), "cluster": pa.array(cluster.astype(np.int32)),
                                              "distance": pa.array(distance), "measured": pa.array(share)})

    return table.mapInArrow(run, "vec_id bigint, cluster int, distance bigint, measured int")


def means(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: the floor of each component's mean; empty ones stay."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, x, cluster, _, _ in _assigned(batches, centroids):
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, x)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some.astype(np.int32)), "n": pa.array(count[some]),
                                          "total": pa.array(list(total[some]), pa.list_(pa.int64()))})

    sums = table.mapInArrow(run, "cluster int, n bigint, total array<bigint>").groupBy("cluster")
    found = sums.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(dim))).alias("total"))
    out = centroids.copy()
    for row in found.collect():  # one row a centroid
        out[row.cluster] = [s // row.n for s in row.total]
    return out


def seeds(table: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors of smallest seeded hash, in its order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = table.select("x", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def cluster(vectors: DataFrame, *, k: int = K, rounds: int = ROUNDS, seed: int = SEED, **columns: object) -> tuple[DataFrame, DataFrame]:
    """The vectors (``vec_id, cluster, distance, measured``) and the centroids
    (``cluster, centroid, n, cluster_inertia``) after ``rounds`` rounds.

    ``measured`` sums to the number of exact distances that the last pass computed.
    """
    spark = vectors.sparkSession
    table = vector_table(vectors, **columns)
    centroids = seeds(table, k, seed)
    if len(centroids):
        for _ in range(rounds):
            centroids = means(table, centroids)
        found = materialize(assign(table, centroids), "clusters")
    else:
        found = spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, measured int")
    sums = found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("cluster_inertia"))
    listed = spark.createDataFrame([(i, [int(v) for v in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<bigint>")
    # k rows on both sides
    return found, listed.join(sums, "cluster", "left").fillna({"n": 0, "cluster_inertia": 0})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the contract's columns for every kept vector."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = centroids.collect()  # one row a centroid
    total = sum(r.cluster_inertia for r in rows)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    told = spark.createDataFrame(
        [(r.cluster, r.cluster_inertia, total, digest(r.centroid)) for r in rows],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds written out one after the other."""
    near = """
{to} AS MATERIALIZED (
  SELECT v.n, v.vec_id, arg_min(c.k, (s.d, c.k)) AS k, min(s.d)::BIGINT AS d FROM v, {c} AS c,
  LATERAL (SELECT list_inner_product(v.x, v.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(v.x, c.x) AS d) AS s
  GROUP BY v.n, v.vec_id
)"""
    mean = """
{to} AS MATERIALIZED (
  SELECT k, list(m::DOUBLE ORDER BY i) AS x FROM (
    SELECT k, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) / count(*) AS m
    FROM (SELECT a.k, generate_subscripts(v.x, 1) AS i, unnest(v.x)::BIGINT AS y FROM {a} AS a JOIN v USING (n)) GROUP BY k, i
  ) GROUP BY k
  UNION ALL SELECT k, x FROM {c} WHERE k NOT IN (SELECT k FROM {a})
)"""
    parts = ["""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64
)""", """
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (
    SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT 40)
)"""]  # fmt: skip
    for i in range(ROUNDS):
        parts += [near.format(to=f"a{i}", c=f"c{i}"), mean.format(to=f"c{i + 1}", a=f"a{i}", c=f"c{i}")]
    parts.append(near.format(to="a", c=f"c{ROUNDS}"))
    listed = "array_to_string(list_transform(c.x, lambda y: y::BIGINT), ',')"
    return ",".join(parts) + f"""
SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256({listed}) AS centroid_sha256
FROM a JOIN c{ROUNDS} AS c USING (k)
"""


SQL = _sql()
