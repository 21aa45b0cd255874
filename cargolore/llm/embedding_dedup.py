"""Near-duplicate embeddings with randomised-rotation binary codes.

Every vector is scaled to length one and rotated by a seeded random rotation.
Stored of it, once, are

* its code: the signs of its components, packed, one bit each;
* its correction factor ``f``, the inner product of the vector and its code;
* its rotated components in four bits each, rounded up or down at random (seeded)
  so that their expectation is the component, with the scale of the rounding.

For vectors ``x`` and ``y``, ``<x in four bits, code of y> / f(y)`` estimates the
cosine without bias.  Its error is about ``sqrt(1 - f^2) / (f sqrt(d - 1))`` from
the code and at most half a step of the scale over ``f`` from the rounding.  A pair
whose estimate plus ``sigmas`` such errors is below the threshold is dropped; what
is left is recomputed exactly, in double precision.

Which pairs are estimated at all: ``tables`` further rotations give bucket keys
of ``bits`` signs each, and pairs meet in the buckets that they share.  Bits
grow with the logarithm of the number of vectors, and tables so that a pair at
the threshold is met with probability ``RECALL`` (closer pairs more surely).
Buckets are cut into blocks, and pairs of blocks are tasks' groups, so a hot
bucket is spread over many tasks.  A pair met in several tables counts in the
first.

Only ids, keys and codes are shuffled to the buckets.  A group tells which of its
vectors have a pair that the bound leaves; for these alone the vectors are joined
and sent to the group's pair of blocks.  Groups return a count and one tree edge a
vector, never pairs.

Defined cases: null vectors, zero vectors, and vectors with null or non-finite
components link with nothing; vectors of other lengths link among themselves
only; equal vectors are compared once and counted with their number; rows with
a null id are returned without links; rows with equal ids are one vector that
holds all their values.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolore.llm.common import hot_join, materialize, mix
from cargolore.llm.components import components

THRESHOLD = 0.9
#: Probability that a pair exactly at the threshold shares a bucket.
RECALL = 0.97
#: Mean vectors in a bucket, about.
BUCKET = 128
#: Vectors in a block of a bucket, at most about.
BLOCK = 512
SIGMAS = 4.0
SEED = 20


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation (orthogonal matrix), the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a bucket key and number of tables for ``n`` vectors."""
    bits = int(min(30, max(4, round(math.log2(max(n, 1) / BUCKET)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def keys_of(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Bucket keys, one row a vector and one column a table."""
    out = np.zeros((len(vectors), tables), np.int32)
    dim, done = vectors.shape[1], 0
    need, turn = bits * tables, 0
    signs = np.zeros((len(vectors), need), bool)
    while done < need:
        part = vectors @ rotation(dim, seed + 1 + turn)[:, : need - done]
        signs[:, done : done + part.shape[1]] = part > 0
        done += part.shape[1]
        turn += 1
    for t in range(tables):
        out[:, t] = signs[:, t * bits : (t + 1) * bits] @ (1 << np.arange(bits, dtype=np.int64))
    return out


_CODES = "vec_id bigint, copies bigint, dim int, code binary, factor float, nibbles binary, low float, step float, keys array<int>"


def encode(v: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Of unit vectors (rows): packed sign codes, correction factors, and the
    rotated components in four bits with their least value and step."""
    dim = v.shape[1]
    y = v @ rotation(dim, seed)
    low = y.min(axis=1)
    step = np.maximum((y.max(axis=1) - low) / 15, 1e-12)
    # the rounding is seeded by the vector's own bytes: equal on every retry
    parts = mix(np.ascontiguousarray(v).view(np.uint64) + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(seed + 1))
    up = (mix(parts) >> np.uint64(11)).astype(np.float64) / 2**53
    level = np.clip(np.floor((y - low[:, None]) / step[:, None] + up), 0, 15).astype(np.uint8)
    if dim % 2:
        level = np.concatenate([level, np.zeros((len(v), 1), np.uint8)], axis=1)
    return {
        "code": np.packbits(y > 0, axis=1), "factor": np.abs(y).sum(1) / math.sqrt(dim),
        "nibbles": level[:, ::2] << 4 | level[:, 1::2], "low": low, "step": step,
    }


def estimates(x: dict[str, np.ndarray], y: dict[str, np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of all rows of ``x`` (four-bit components) and ``y`` (codes),
    and the standard error of each."""
    level = np.empty((len(x["nibbles"]), x["nibbles"].shape[1] * 2), np.float32)
    level[:, ::2], level[:, 1::2] = x["nibbles"] >> 4, x["nibbles"] & 15
    value = level[:, :dim] * x["step"][:, None].astype(np.float32) + x["low"][:, None].astype(np.float32)
    sign = (np.unpackbits(y["code"], axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    factor = y["factor"].astype(np.float32)
    by_code = np.maximum(0, 1 - factor**2) / (factor**2 * (dim - 1))
    by_step = (x["step"].astype(np.float32) ** 2 / 4)[:, None] / (factor**2)[None, :]
    return value @ sign.T / factor, np.sqrt(by_code[None, :] + by_step)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the first node of its component, by the given links."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _column(table: pa.Table, name: str) -> np.ndarray:
    """A column of equally long binary values as rows of bytes."""
    return np.frombuffer(b"".join(table[name].to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _blocks(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a group's two blocks."""
    block = table["block"].to_numpy()
    return np.flatnonzero(block == table["low_block"][0].as_py()), np.flatnonzero(block == table["high_block"][0].as_py())


def _new_pairs(table: pa.Table, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of rows once, and only in the first table whose key it shares."""
    ids, at = table["vec_id"].to_numpy(), int(table["t"][0].as_py())
    keep = (ids[i] < ids[j]) if table["low_block"][0].as_py() == table["high_block"][0].as_py() else (ids[i] != ids[j])
    i, j = i[keep], j[keep]
    if at and len(i):
        keys = np.stack(table["keys"].to_numpy())[:, :at]
        first = np.ones(len(i), bool)
        for t in range(at):
            first &= keys[i, t] != keys[j, t]
        i, j = i[first], j[first]
    return i, j


def _estimate_blocks(threshold: float, sigmas: float):  # noqa: ANN202
    """The vectors of a pair of blocks that have a pair the bound leaves."""

    def run(table: pa.Table) -> pa.Table:
        a, b = _blocks(table)
        dim, some = table["dim"][0].as_py(), np.zeros(table.num_rows, bool)
        if len(a) and len(b):
            if dim < 2:
                i, j = np.repeat(a, len(b)), np.tile(b, len(a))
            else:
                code, nibbles = _column(table, "code"), _column(table, "nibbles")
                factor, low, step = (table[n].to_numpy() for n in ("factor", "low", "step"))
                x = {"nibbles": nibbles[a], "low": low[a], "step": step[a]}
                found, error = estimates(x, {"code": code[b], "factor": factor[b]}, dim)
                i, j = np.nonzero(found + sigmas * error >= threshold)
                i, j = a[i], b[j]
            i, j = _new_pairs(table, i, j)
            some[i] = some[j] = True
        return table.select(["dim", "t", "key", "low_block", "high_block", "block", "vec_id"]).filter(pa.array(some))

    return run


def _recompute_blocks(threshold: float):  # noqa: ANN202
    """Exact cosines of the vectors that a pair of blocks has left."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids, copies, rows = table["vec_id"].to_numpy(), table["copies"].to_numpy(), table.num_rows
        flat = table["e"].combine_chunks()
        v = flat.values.to_numpy(zero_copy_only=False)[flat.offsets[0].as_py() : flat.offsets[-1].as_py()].reshape(rows, -1)
        v = unit_rows(v)
        a, b = _blocks(table)
        i, j = np.nonzero(v[a] @ v[b].T >= threshold - 1e-9) if len(a) and len(b) else (a[:0], b[:0])
        i, j = _new_pairs(table, a[i], b[j])
        keep = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
        i, j = i[keep], j[keep]
        links = np.zeros(rows, np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        some = np.flatnonzero(links)
        return pa.table({"vec_id": ids[some], "n": links[some], "root": ids[roots(rows, i, j)][some]})

    return run


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def code_table(texts: DataFrame, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """Codes, factors, four-bit components and bucket keys of ``rep, copies, e``."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            size = pa.compute.list_value_length(lists).to_numpy()
            for dim in np.unique(size):
                own = batch.filter(pa.array(size == dim))
                v = unit_rows(np.stack(own.column("e").to_numpy(zero_copy_only=False)))
                code, keys = encode(v, seed), keys_of(v, bits, tables, seed)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": own.column("rep"), "copies": own.column("copies"), "dim": pa.array(np.full(len(v), dim, np.int32)),
                    "code": pa.array([x.tobytes() for x in code["code"]], pa.binary()), "factor": pa.array(code["factor"], pa.float32()),
                    "nibbles": pa.array([x.tobytes() for x in code["nibbles"]], pa.binary()), "low": pa.array(code["low"], pa.float32()),
                    "step": pa.array(code["step"], pa.float32()), "keys": pa.array(list(keys), pa.list_(pa.int32())),
                })

    return texts.mapInArrow(coded, _CODES)


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, sigmas: float = SIGMAS, seed: int = SEED) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    # equal vectors are told by 128 bits of their components
    known = rows.where(usable).select("vec_id", "e", F.xxhash64("e").alias("h1"), F.xxhash64(F.lit(seed), F.reverse("e")).alias("h2"))
    texts = known.groupBy("h1", "h2").agg(F.min_by("e", "vec_id").alias("e"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    texts = materialize(texts, "vectors")
    bits, tables = plan_tables(texts.count(), threshold, recall)
    codes = materialize(code_table(texts, bits, tables, seed), "vector-codes")

    group = ["dim", "t", "key", "low_block", "high_block"]
    placed = codes.select("*", F.posexplode("keys").alias("t", "key"))
    sizes = placed.groupBy("dim", "t", "key").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    met = hot_join(placed, sizes, ["dim", "t", "key"], "m", F.xxhash64("vec_id"))
    met = met.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).withColumns({
        "low_block": F.least("block", "o").cast("int"), "high_block": F.greatest("block", "o").cast("int"),
    })
    met = met.select(*codes.columns, *group[1:], "block")
    left = met.groupBy(*group).applyInArrow(_estimate_blocks(threshold, sigmas), "dim int, t int, key int, low_block int, high_block int, block int, vec_id bigint")
    left = materialize(left, "vectors-left")
    often = materialize(left.groupBy("vec_id").agg(F.count("*").alias("times")), "times-left")
    held = texts.select(F.col("rep").alias("vec_id"), "copies", "e").join(often, "vec_id").join(codes.select("vec_id", "keys"), "vec_id")
    exact = hot_join(left, held, ["vec_id"], "times", F.xxhash64(*group)).select(*group, "block", "vec_id", "copies", "e", "keys")
    found = materialize(exact.groupBy(*group).applyInArrow(_recompute_blocks(threshold), "vec_id bigint, n bigint, root bigint"), "vector-links")

    groups = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    of_rep = texts.join(counts, texts["rep"] == counts["vec_id"], "left").join(groups, texts["rep"] == groups["node"], "left")
    of_rep = of_rep.select("h1", "h2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = hot_join(known.select("vec_id", "h1", "h2"), materialize(of_rep, "vector-classes"), ["h1", "h2"], "copies", F.xxhash64("vec_id"))
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the contract's columns for every vector."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, c.c = vec_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
