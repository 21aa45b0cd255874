"""Exact nearest vectors by cosine, with both sides spread over cells.

A seeded sample of the corpus gives centroids.  Every row goes to the cell of its nearest
centroid, and a cell has a radius, the distance of its farthest row.  For unit vectors
the triangle inequality says how near a row of a cell can be to a query.  Queries first
search their own cell; of the others they visit those that may hold a row nearer than
the ``k``-th found there.  So no cell that could matter is left out, and the result is exact.

Cells are cut into blocks of rows, and a cell's queries into blocks too; a pair of blocks is
a task's group, and a matrix product for each strip of its queries.  What reaches the driver is the sample and a row
a cell; no query does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolore.sources.scratch import stored

#: Centroids for vectors of one length, at most, and rows for which there is one, about.
CELLS, CELL_ROWS = 256, 512
#: Rows and queries of a tile, about.
TILE_ROWS, TILE_QUERIES = 4096, 2048
#: Queries of a tile that are compared at a time.
STRIP_QUERIES = 256
SEED = 13
#: More than the error of a distance made from a cosine in double precision.
MARGIN = 1e-6

Centroids = dict[int, np.ndarray]


def unit_rows(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which of them have a direction."""
    with np.errstate(all="ignore"):
        most = np.abs(v).max(axis=1, initial=0.0)
        scaled = v / np.where((most > 0) & np.isfinite(most), most, 1.0)[:, None]
        norm = np.linalg.norm(scaled, axis=1)
    some = np.isfinite(norm) & (norm > 0) & np.isfinite(most)
    return np.where(some[:, None], scaled / np.where(some, norm, 1.0)[:, None], 0.0), some


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _rows(df: DataFrame, vector: str, keys: str | None) -> DataFrame:
    """``id, keys, dim, e`` of the rows whose vector has numbers only."""
    own = F.col(vector).cast("array<double>")
    listed = F.col(keys).cast("array<string>") if keys else F.lit(None).cast("array<string>")
    named = df.select(F.col(df.columns[0]).alias("id"), listed.alias("keys"), own.alias("e"))
    return named.where(F.coalesce(F.forall("e", lambda x: x.isNotNull()) & (F.size("e") > 0), F.lit(False))).withColumn("dim", F.size("e"))


def centroids_of(rows: DataFrame) -> Centroids:
    """A seeded sample of at most ``CELLS`` rows for each length, as unit rows."""
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a length
    out: Centroids = {}
    for dim, n in sizes.items():
        wanted = min(CELLS, math.ceil(n / CELL_ROWS))
        some = rows.where(F.col("dim") == dim).select("e", F.xxhash64(F.lit(SEED), "e").alias("h")).orderBy("h").limit(wanted).collect()
        unit, known = unit_rows(np.array([r.e for r in some]))
        out[dim] = np.unique(unit[known], axis=0) if known.any() else np.eye(1, dim)
    return out


def _placed(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """Rows with a direction, as unit vectors ``u`` with their ``cell`` and how ``far`` its centroid is."""
    schema = T.StructType([rows.schema["id"], rows.schema["keys"], *T.StructType.fromDDL("dim int, cell int, far double, u array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if dim in centroids:
                    own = batch.filter(pa.array(dims == dim))
                    unit, known = unit_rows(_matrix(own.column("e")))
                    own, unit = own.filter(pa.array(known)), unit[known]
                    near = unit @ centroids[dim].T
                    cell = near.argmax(axis=1) if len(unit) else np.zeros(0, np.int64)
                    far = np.linalg.norm(unit - centroids[dim][cell], axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [own.column("id"), own.column("keys"), own.column("dim"), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(list(unit), pa.list_(pa.float64()))],
                        names=["id", "keys", "dim", "cell", "far", "u"],
                    )

    return rows.mapInArrow(run, schema)


def _others(asked: DataFrame, centroids: Centroids, radii: dict[tuple[int, int], float], k_of: str) -> DataFrame:
    """Queries with each cell but their own that may hold a row as near as cosine ``k_of``
    (all cells where that is null)."""
    schema = T.StructType([f for f in asked.schema.fields if f.name != k_of])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, home = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            bound = batch.column(k_of).to_numpy(zero_copy_only=False).astype(float)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                middle = centroids[dim]
                unit = _matrix(batch.column("u").take(pa.array(at)))
                gap = np.sqrt(np.maximum(0, 2 - 2 * unit @ middle.T)) - np.array([radii.get((dim, c), -math.inf) for c in range(len(middle))])
                reach = np.where(np.isnan(bound[at]), math.inf, np.sqrt(np.maximum(0, 2 - 2 * bound[at])) + MARGIN)
                row, cell = np.nonzero((gap <= reach[:, None]) & (np.arange(len(middle))[None, :] != home[at][:, None]) & np.isfinite(gap))
                for start in range(0, len(row), 10_000):
                    part = slice(start, start + 10_000)
                    out = batch.select([f.name for f in schema.fields]).take(pa.array(at[row[part]]))
                    yield out.set_column(out.schema.get_field_index("cell"), "cell", pa.array(cell[part].astype(np.int32)))

    return asked.mapInArrow(run, schema)


def _tile(k: int, types: tuple[pa.DataType, pa.DataType], filtered: bool):  # noqa: ANN202
    """Each query's best rows in a pair of blocks, of equal scores those of lesser id."""

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        names = ["query_id", "hs_code", "similarity"]
        if not len(q) or not len(c):
            return pa.table([pa.array([], types[0]), pa.array([], types[1]), pa.array([], pa.float64())], names=names)
        unit = _matrix(table["u"].combine_chunks())
        one, two = (table[n].combine_chunks() for n in ("query_id", "hs_code"))
        place = np.empty(len(c), np.int64)
        place[pc.sort_indices(two.take(pa.array(c)), null_placement="at_start").to_numpy()] = np.arange(len(c))
        if filtered:
            lists = table["keys"].to_pylist()
            slot: dict[str, int] = {}
            for i in q:
                for x in lists[i] or []:
                    slot.setdefault(x, len(slot))
            has = np.zeros((len(lists), len(slot) + 1), np.float32)
            for i, own in enumerate(lists):
                has[i, [slot[x] for x in own or [] if x is not None and x in slot]] = 1
        rows, cols, values = [], [], []
        for start in range(0, len(q), STRIP_QUERIES):
            asked = q[start : start + STRIP_QUERIES]
            value = unit[asked] @ unit[c].T
            if filtered:
                value = np.where(has[asked] @ has[c].T > 0, value, -2.0)
            least = np.partition(value, -k, axis=1)[:, -k] if value.shape[1] > k else np.full(len(value), -2.0)
            row, col = np.nonzero((value > -1.5) & (value >= least[:, None] - 1e-11))
            order = np.lexsort((place[col], -np.round(value[row, col], 12), row))
            row, col = row[order], col[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            rows.append(row[first] + start)
            cols.append(col[first])
            values.append(value[row[first], col[first]])
        row, col, value = (np.concatenate(x) for x in (rows, cols, values))
        return pa.table([one.take(pa.array(q[row])), two.take(pa.array(c[col])), pa.array(value)], names=names)

    return run


def _searched(visits: DataFrame, placed: DataFrame, sizes: dict[tuple[int, int], int], k: int, filtered: bool) -> DataFrame:
    """Hits ``query_id, hs_code, similarity`` of queries in the cells that they visit."""
    spark = placed.sparkSession
    asked = {(r.dim, r.cell): r.n for r in visits.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    blocks = [(d, c, -(-sizes[d, c] // TILE_ROWS), -(-n // TILE_QUERIES)) for (d, c), n in asked.items() if (d, c) in sizes]
    table = F.broadcast(spark.createDataFrame(blocks, "dim int, cell int, row_blocks int, query_blocks int"))  # a row a cell
    one, two = visits.schema["id"].dataType, placed.schema["id"].dataType

    def dealt(df: DataFrame, asks: bool) -> DataFrame:
        own, other = ("query_blocks", "row_blocks") if asks else ("row_blocks", "query_blocks")
        part = F.pmod(F.xxhash64("id", "u"), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        met = df.join(table, ["dim", "cell"])
        ids = (F.col("id"), F.lit(None).cast(two)) if asks else (F.lit(None).cast(one), F.col("id"))
        met = met.select("dim", "cell", F.lit(asks).alias("asks"), ids[0].alias("query_id"), ids[1].alias("hs_code"), "keys", "u", part.alias("own"), each.alias("other"))
        names = ("query_block", "row_block") if asks else ("row_block", "query_block")
        return met.withColumnsRenamed({"own": names[0], "other": names[1]})

    tiles = dealt(visits, True).unionByName(dealt(placed, False)).groupBy("dim", "cell", "row_block", "query_block")
    arrow = spark.createDataFrame([], T.StructType([T.StructField("a", one), T.StructField("b", two)])).toArrow().schema
    found = T.StructType([T.StructField("query_id", one), T.StructField("hs_code", two), T.StructField("similarity", T.DoubleType())])
    return tiles.applyInArrow(_tile(k, (arrow.field(0).type, arrow.field(1).type), filtered), found)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, among: tuple[str, str] | None = None) -> DataFrame:
    """Hits ``query_id, hs_code, similarity``, among which are the ``k`` best of every query.

    ``queries``: an id and a vector ``q``; ``corpus``: an id and a vector ``v``; ``among``
    names a list column of each: only rows that share a value with the query are looked at.
    """
    rows = stored(_rows(corpus, "v", among[1] if among else None), "vector-rows")
    centroids = centroids_of(rows)
    placed = stored(_placed(rows, centroids), "vector-cells")
    cells = placed.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()  # a row a cell
    radii, sizes = {(r.dim, r.cell): r.far for r in cells}, {(r.dim, r.cell): r.n for r in cells}
    asked = stored(_placed(_rows(queries, "q", among[0] if among else None), centroids).drop("far"), "vector-queries")
    own = stored(_searched(asked, placed.drop("far"), sizes, k, bool(among)), "vector-hits")
    # the k-th best so far; equal scores count each
    best = F.sort_array(F.collect_list("similarity"), asc=False)
    tops = own.groupBy("query_id").agg(F.count("*").alias("n"), best.alias("best")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("best")[k - 1].alias("kth"))
    rest = _others(asked.join(tops, "id", "left"), centroids, radii, "kth")
    return own.unionByName(_searched(rest, placed.drop("far"), sizes, k, bool(among)))
