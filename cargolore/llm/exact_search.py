"""Exact top-k search by tiled matrix products.

Components are turned into integers, ``floor(scale * x)``.  Queries are dealt to
blocks and all rows to shards, both by a fixed hash of the row's number, so that
equal vectors or ids never gather.  A block and a shard are a tile, and a tile is
a task's group: one matrix product gives all its scores, and a partial selection
keeps each query's ``k`` best.  The tiles' lists are merged as a tree, ``FAN``
lists at a time, by grouped aggregation, so no task gets all lists of a query.

A matrix product in double precision is exact while every sum stays below 2^53;
a tile whose components are too large for that is computed with Python's integers.

Defined cases: vectors that are null or hold null or non-finite components are
neither query nor candidate; vectors of other lengths are no candidates of each
other; a row is told by its number, so rows that repeat an id are candidates of
each other, and each is a query of its own where the id asks for one; a null id
is no query, and as a candidate comes after all ids of its score; scores that a
64-bit integer cannot hold are cut to its ends; extra columns are not read.  A
query without candidates gives no row, and an empty table none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolore.llm.common import materialize

K = 10
SCALE = 1024
#: Queries in a block and rows in a shard, about.
BLOCK, SHARD = 4096, 1024
#: Lists that one step of the tree merges.
FAN = 16

_LAST = 2**63 - 1
_TOP = "down bigint, unnamed boolean, vec_id bigint, row bigint"
_TILE = f"row bigint, query_id bigint, shard int, top array<struct<{_TOP.replace(' ', ': ').replace(',:', ',')}>>"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def matrix(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """Chosen rows of a column of equally long lists."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)[rows]


def products(queries: np.ndarray, shard: np.ndarray, scale: int) -> np.ndarray:
    """Exact inner products of ``floor(scale * x)``, one row a query."""
    most = [float(np.abs(m).max(initial=0)) * scale + 1 for m in (queries, shard)]
    if max(most) < 2**53 and most[0] * most[1] * max(1, queries.shape[1]) < 2**53:
        return (np.floor(scale * queries) @ np.floor(scale * shard).T).astype(np.int64)
    # doubles of 2^53 and more are whole numbers
    whole = lambda x: int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x)
    left, right = (np.array([[whole(float(x)) for x in row] for row in m], object).reshape(m.shape) for m in (queries, shard))
    return np.clip(left @ right.T, -_LAST, _LAST).astype(np.int64)


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores, the earlier of equal ones first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")][:k]


def _tile(k: int, scale: int):  # noqa: ANN202
    """Each query's ``k`` best rows of one tile."""

    def run(table: pa.Table) -> pa.Table:
        # by id, nulls last, then by number: the order of equal scores
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        asks = table["asks"].to_numpy()
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        rows, ids = table["row"].to_numpy(), table["vec_id"].combine_chunks()
        kept, ends = [], [0]
        if len(q) and len(c):
            scores = products(matrix(table["e"], q), matrix(table["e"], c), scale)
            for at, own in zip(q, scores, strict=True):
                best = select(own, k + 1)  # one more, as the query's own row may be among them
                best = best[rows[c[best]] != rows[at]][:k]
                kept.append((own[best], c[best]))
                ends.append(ends[-1] + len(best))
        score = np.concatenate([s for s, _ in kept]) if kept else np.zeros(0, np.int64)
        place = np.concatenate([p for _, p in kept]) if kept else np.zeros(0, np.int64)
        named = ids.take(pa.array(place))
        top = pa.StructArray.from_arrays(
            [pa.array(-score), named.is_null(), named, pa.array(rows[place])], names=["down", "unnamed", "vec_id", "row"]
        )
        q = q[: len(kept)]
        return pa.table({
            "row": rows[q], "query_id": ids.take(pa.array(q)), "shard": table["shard"].combine_chunks().take(pa.array(q)),
            "top": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), top),
        })

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = K,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    block: int = BLOCK,
    shard: int = SHARD,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest integer inner products
    of every row for which ``is_query`` holds with all other rows.

    ``block``, ``shard``: queries and rows of a tile, about; they change the plan only.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"),
                           F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = named.where(usable(F.col("e"))).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "search-rows")
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked // block))

    part = lambda seed, parts: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    keys = ["dim", "block", "shard"]
    rows = rows.withColumn("dim", F.size("e"))
    candidates = rows.withColumns({"asks": F.lit(False), "shard": part(1, shards)}).withColumn("block", every(blocks))
    queries = rows.where("asks").withColumn("block", part(2, blocks)).withColumn("shard", every(shards))
    tiles = candidates.unionByName(queries).groupBy(*keys).applyInArrow(_tile(k, scale), _TILE)
    lists = materialize(tiles, "search-tiles")
    while shards > 1:
        shards = -(-shards // FAN)
        best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        step = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        lists = step.groupBy("row", "query_id", "shard").agg(best.alias("top"))
    found = lists.select("query_id", F.posexplode("top").alias("place", "hit"))
    return found.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.down")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the ten best of every vector whose id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND q.n <> c.n AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
