"""Learning to rank by boosted trees on listwise gradients (LambdaMART).

Rows are held as one list a query, binned once and written.  Each round

* adds the last trees to the scores and takes each query's pair gradients, weighted
  by the change of NDCG that exchanging the pair would make (a pair counts if its
  better placed row is among the first ``truncation``); what a row gets from its
  pairs is summed to a gradient and a Hessian;
* grows one tree leaf by leaf, always at the leaf of the largest gain.  Histograms of
  gradients by feature and bin are summed in Spark, for the lower child of every
  open leaf at once; the upper child is the difference from its parent.  So a tree
  needs about as many jobs as it is deep.

Gradients are summed as whole numbers (``UNIT`` of one), so neither the order of
partitions nor a task that is run again can change a tree.  The driver sees only
histograms, whose size is leaves x features x bins.

Rows with the same bins have the same score, whatever the trees.  Where there are at most
``CELLS`` different rows of bins, a round is one job instead: the driver keeps a score for each,
tasks take the gradients of lists of these and sum them by row of bins, and the tree is grown
from these sums.  Lists without any grade have no gradient then and are not read again; their rows count.
The trees are the same.

Defined cases: a missing feature counts as 0, a missing grade as 0; rows without a
query are left out; a query whose grades are all equal has no gradient and no NDCG;
a table without gradients gives a model of no trees, which scores all rows 0.  A query's
list is one row, bounded by the number of candidates that retrieval keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolore.sources.scratch import stored

ROUNDS, LEAVES, RATE, MIN_ROWS, TRUNCATION, BINS = 300, 31, 0.05, 5, 50, 63
#: Rounds without a better NDCG on held-out queries after which training ends.
PATIENCE = 20
#: Rounds after which scores are written anew.
STORE = 25
UNIT = 2.0**30
#: Rows of lists of one length that are taken as one matrix, about.
LIST_CELLS = 65_536
#: Different rows of bins up to which a tree is grown from their sums.
CELLS = 16_384
AT = (1, 3, 5)


@dataclass
class Tree:
    """Nodes by number, the root first; a leaf has feature -1.  A row goes left if
    its bin of ``feature`` is at most ``cut``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, n, n + 1
        for name, blank in (("feature", -1), ("cut", 0), ("left", 0), ("right", 0), ("value", 0.0)):
            getattr(self, name).extend([blank] * 2)
        return n, n + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        while (open_ := np.flatnonzero(feature[at] >= 0)).size:
            own = at[open_]
            at[open_] = np.where(bins[open_, feature[own]] <= cut[own], left[own], right[own])
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


def discounts(n: int) -> np.ndarray:
    return 1 / np.log2(np.arange(n) + 2)


def gains(grades: np.ndarray) -> np.ndarray:
    return 2.0**grades - 1


def ndcg(grades: np.ndarray, scores: np.ndarray, k: int) -> float | None:
    """NDCG of a list at ``k``; none where all grades are 0.  Ties keep the list's order."""
    best = np.sort(gains(grades))[::-1][:k]
    if not best.any():
        return None
    own = gains(grades)[np.argsort(-scores, kind="stable")][:k]
    return float((own * discounts(len(own))).sum() / (best * discounts(len(best))).sum())


def gradients(grades: np.ndarray, scores: np.ndarray, truncation: int) -> tuple[np.ndarray, np.ndarray]:
    """A gradient and a Hessian for each row of a query's list, in ``UNIT``s."""
    g, h = gradients_of(grades[None, :], scores[None, :], truncation)
    return g[0], h[0]


def gradients_of(grades: np.ndarray, scores: np.ndarray, truncation: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`gradients` of lists of one length, a row a list."""
    m, n = grades.shape
    g, h = np.zeros((m, n)), np.zeros((m, n))
    ideal = np.sort(gains(grades), axis=1)[:, ::-1][:, :truncation]
    total = (ideal * discounts(ideal.shape[1])).sum(axis=1)
    some = np.flatnonzero(total > 0) if n > 1 else np.zeros(0, np.int64)
    if some.size:
        order = np.argsort(-scores[some], axis=1, kind="stable")
        disc = np.where(np.arange(n) < truncation, discounts(n), 0.0)
        sr, ss = np.take_along_axis(grades[some], order, 1), np.take_along_axis(scores[some], order, 1)
        sg, total = gains(sr), total[some][:, None]
        gs, hs = np.zeros(sr.shape), np.zeros(sr.shape)
        # place i with all later places, i among the first
        for i in range(min(truncation, n - 1)):
            own, rest = slice(i, i + 1), slice(i + 1, n)
            sign = np.sign(sr[:, own] - sr[:, rest])  # 1 where i is the better
            weight = np.abs(sg[:, own] - sg[:, rest]) * np.abs(disc[i] - disc[rest]) / total
            p = 1 / (1 + np.exp(np.clip(sign * (ss[:, own] - ss[:, rest]), -500, 500)))
            slope, bend = sign * weight * p, np.where(sign != 0, weight * p * (1 - p), 0.0)
            gs[:, i] -= slope.sum(axis=1)
            hs[:, i] += bend.sum(axis=1)
            gs[:, rest] += slope
            hs[:, rest] += bend
        put = np.zeros(sr.shape)
        np.put_along_axis(put, order, gs, 1)
        g[some] = put
        put = np.zeros(sr.shape)
        np.put_along_axis(put, order, hs, 1)
        h[some] = put
    return np.rint(g * UNIT).astype(np.int64), np.rint(h * UNIT).astype(np.int64)


def ndcg_of_lists(grades: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """:func:`ndcg` of lists of one length, a row a list; NaN where there is none."""
    if not grades.shape[1]:
        return np.full(len(grades), np.nan)
    best = np.sort(gains(grades), axis=1)[:, ::-1][:, :k]
    own = np.take_along_axis(gains(grades), np.argsort(-scores, axis=1, kind="stable"), 1)[:, :k]
    disc = discounts(best.shape[1])
    total = (best * disc).sum(axis=1)
    return np.where(best.any(axis=1), (own * disc).sum(axis=1) / np.where(total, total, 1.0), np.nan)


def best_split(hist: np.ndarray, min_rows: int) -> tuple[float, int, int] | None:
    """Gain, feature and cut of a node's best split; ``hist`` is (3, features, bins) of
    gradients, Hessians and rows.  Ties go to the lesser feature, then cut."""
    if hist.shape[2] < 2:
        return None
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    whole = hist[:, 0, :].sum(axis=1)
    right = whole[:, None, None] - left
    fit = lambda s: np.where(s[1] > 0, (s[0] / UNIT) ** 2 / np.maximum(s[1] / UNIT, 1e-12), 0.0)
    gain = fit(left) + fit(right) - fit(whole[:, None, None])
    allowed = (left[2] >= min_rows) & (right[2] >= min_rows) & (left[1] > 0) & (right[1] > 0)
    gain = np.where(allowed, np.round(gain, 12), -1.0)
    at = int(gain.argmax())
    value = float(gain.flat[at])
    return (value, at // gain.shape[1], at % gain.shape[1]) if value > 1e-9 else None


def leaf_value(hist: np.ndarray, rate: float) -> float:
    g, h, _ = hist[:, 0, :].sum(axis=1)
    return float(-rate * g / h) if h > 0 else 0.0


class Ranker:
    """A fitted model: ``column(...)`` scores rows, ``history`` has held-out NDCG by round."""

    def __init__(self, features: list[str], edges: list[list[float]], trees: list[Tree], history: list[dict[str, float]]) -> None:
        self.features, self.edges, self.trees, self.history = features, edges, trees, history

    def column(self, *features: Column) -> Column:
        """The score of a row (``fuse`` takes it as its ``model``), by default of the named columns."""
        edges, trees = self.edges, self.trees
        known: dict[bytes, float] = {}

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.fillna(0.0).to_numpy(float) for c in columns], axis=1)
            # equal rows of bins are scored once
            own, at, table = distinct_bins(bin_rows(x, edges))
            new = [i for i, b in enumerate(own) if b not in known]
            if len(known) + len(new) > CELLS:
                known.clear()
                new = range(len(own))
            for i, value in zip(new, sum((t.scores(table[new]) for t in trees), np.zeros(len(new))), strict=True):
                known[own[i]] = value
            return pd.Series(np.array([known[b] for b in own] or [0.0])[at])

        return score(*(c.cast("double") for c in features or map(F.col, self.features)))


def bin_rows(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The bin of each value: how many edges lie below it."""
    return np.stack([np.searchsorted(np.array(e), x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def distinct_bins(bins: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different rows of ``bins`` as bytes, which of them each row is, and as a table."""
    flat = np.ascontiguousarray(bins).view(np.dtype((np.void, bins.shape[1]))).ravel()
    _, first, at = np.unique(flat, return_index=True, return_inverse=True)
    return [flat[i].tobytes() for i in first], at, bins[first]


def lists_of(rows: DataFrame, features: list[str], edges: list[list[float]], query: str, grade: str, held_out: int) -> DataFrame:
    """One row a query: whether it is held out, and its rows' bins, grades and scores, written."""
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    row = F.struct(F.array(*values).alias("x"), F.coalesce(F.col(grade).cast("double"), F.lit(0.0)).alias("grade"))
    held = F.pmod(F.xxhash64(F.lit("held"), query), F.lit(held_out)) == 0 if held_out else F.lit(False)
    lists = rows.where(F.col(query).isNotNull()).groupBy(held.alias("held"), F.col(query).alias("__q")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    lists = lists.select("held", F.col("rows.x").alias("x"), F.col("rows.grade").alias("grade"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, grade = batch.column("x"), batch.column("grade").flatten().to_numpy()
            size = np.diff(x.offsets.to_numpy())
            bins = bin_rows(x.flatten().flatten().to_numpy().reshape(-1, len(edges)), edges)
            ends = np.append(0, np.cumsum(size * len(edges))).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "held": batch.column("held"), "bins": pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bins))]),
                "grades": _lists(grade, size), "scores": _lists(np.zeros(len(grade)), size),
            })

    return stored(lists.mapInArrow(run, "held boolean, bins binary, grades binary, scores binary"), "ranking-lists")


def _ends(column: pa.Array) -> np.ndarray:
    """Where the values of a binary column begin and end in its bytes."""
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]


def _bytes(column: pa.Array) -> memoryview:
    """The bytes of a binary column, its values one after the other."""
    ends = _ends(column)
    return memoryview(column.buffers()[2] or b"")[ends[0] : ends[-1]] if len(column) else memoryview(b"")


def _lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary column of lists of ``size`` values of 8 bytes."""
    ends = np.append(0, np.cumsum(size * 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _advanced(lists: DataFrame, trees: list[Tree], width: int, truncation: int | None) -> DataFrame:
    """Lists with the trees' scores added; with a ``truncation``, their gradients and NDCG too."""
    kinds = "held boolean, bins binary, grades binary, scores binary"
    schema = kinds if truncation is None else f"{kinds}, g binary, h binary, " + ", ".join(f"ndcg{k} double" for k in AT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, grade, grown = (np.frombuffer(_bytes(batch.column(c)), t) for c, t in (("bins", np.uint8), ("grades", np.float64), ("scores", np.float64)))
            grown = grown + sum((t.scores(bins.reshape(-1, width)) for t in trees), np.zeros(len(grown)))
            size = np.diff(_ends(batch.column("grades"))) // 8
            columns = {n: batch.column(n) for n in ("held", "bins", "grades")} | {"scores": _lists(grown, size)}
            if truncation is not None:
                g, h = np.zeros(len(grade), np.int64), np.zeros(len(grade), np.int64)
                found = {k: np.full(len(size), np.nan) for k in AT}
                start = np.cumsum(size) - size
                # lists of one length are one matrix
                for n in np.unique(size):
                    own = np.flatnonzero(size == n)
                    for part in np.array_split(own, -(-len(own) * int(n) // LIST_CELLS) or 1):
                        at = start[part][:, None] + np.arange(n)[None, :]
                        g[at], h[at] = gradients_of(grade[at], grown[at], truncation)
                        for k in AT:
                            found[k][part] = ndcg_of_lists(grade[at], grown[at], k)
                columns |= {"g": _lists(g, size), "h": _lists(h, size)} | {f"ndcg{k}": pa.array(found[k], from_pandas=True) for k in AT}
            yield pa.RecordBatch.from_pydict(columns)

    return lists.mapInArrow(run, schema)


def histograms(state: DataFrame, tree: Tree, parts: dict[int, tuple[int, int]] | None, width: int, bins: int) -> dict[int, np.ndarray]:
    """Sums of gradients, Hessians and rows by feature and bin: of all rows (``parts``
    none), or for each open leaf of the rows that its split would send left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = list(parts or [0])
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = np.arange(len(nodes))
        feature, cut = (np.array([parts[n][i] for n in nodes] if parts else [0]) for i in (0, 1))
        sums = np.zeros((len(nodes), 3, width, bins), np.int64)
        for batch in batches:
            table = np.frombuffer(_bytes(batch.column("bins")), np.uint8).reshape(-1, width)
            g, h = (np.frombuffer(_bytes(batch.column(c)), np.int64) for c in "gh")
            at = slot[tree.nodes(table)]
            own = np.flatnonzero(at >= 0)
            if parts is not None:
                own = own[table[own, feature[at[own]]] <= cut[at[own]]]
            # whole numbers in two halves, so that sums of doubles are exact
            halves = [(kind, scale, part.astype(float)) for kind, x in ((0, g[own]), (1, h[own])) for scale, part in ((1 << 20, x >> 20), (1, x & 0xFFFFF))]
            for f in range(width):
                key = at[own] * bins + table[own, f]
                count = lambda values=None: np.bincount(key, values, len(nodes) * bins).reshape(len(nodes), bins).astype(np.int64)  # noqa: B023, E731
                sums[:, 2, f] += count()
                for kind, scale, part in halves:
                    sums[:, kind, f] += count(part) * scale
        for node, hist in zip(nodes, sums, strict=True):
            f, b = np.nonzero(hist[2])
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(np.full(len(f), node, np.int32)), "f": pa.array(f.astype(np.int32)), "b": pa.array(b.astype(np.int32)),
                **{n: pa.array(hist[i, f, b]) for i, n in enumerate(("g", "h", "n"))},
            })

    cells = state.where("NOT held").mapInArrow(run, "node int, f int, b int, g bigint, h bigint, n bigint")
    found: dict[int, np.ndarray] = {node: np.zeros((3, width, bins), np.int64) for node in parts or [0]}
    for r in cells.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect():  # leaves x features x bins
        found[r.node][:, r.f, r.b] = r.g, r.h, r.n
    return found


def cells_of(lists: DataFrame, width: int) -> tuple[list[bytes], np.ndarray] | None:
    """The different rows of bins and how many rows that are not held out have each; none if
    there are more than ``CELLS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at, _ = distinct_bins(np.frombuffer(_bytes(batch.column("bins")), np.uint8).reshape(-1, width))
            fitted = np.repeat(~batch.column("held").to_numpy(zero_copy_only=False), np.diff(_ends(batch.column("bins"))) // width)
            yield pa.RecordBatch.from_pydict({"bins": pa.array(own, pa.binary()), "n": pa.array(np.bincount(at[fitted], minlength=len(own)).astype(np.int64))})

    counted = lists.mapInArrow(run, "bins binary, n bigint").groupBy("bins").agg(F.sum("n").alias("n"))
    found = sorted((bytes(r.bins), r.n) for r in counted.limit(CELLS + 1).collect())
    return None if len(found) > CELLS else ([b for b, _ in found], np.array([n for _, n in found], np.int64))


class _Lists:
    """Training on lists with a score for each row."""

    def __init__(self, lists: DataFrame, width: int, bins: int, truncation: int, held_out: int) -> None:
        self.lists, self.width, self.bins, self.truncation, self.held_out, self.done = lists, width, bins, truncation, held_out, 0

    def seen(self, trees: list[Tree]) -> dict[str, float | None]:
        """NDCG after ``trees``; their gradients are held until :meth:`left`."""
        if len(trees) - self.done >= STORE:
            self.lists, self.done = stored(_advanced(self.lists, trees[self.done :], self.width, None), "ranking-lists"), len(trees)
        self.state = _advanced(self.lists, trees[self.done :], self.width, self.truncation).persist(StorageLevel.DISK_ONLY)
        return self.state.where("held" if self.held_out else "true").agg(*(F.avg(f"ndcg{k}").alias(f"ndcg{k}") for k in AT)).first().asDict()

    def histograms(self, tree: Tree, parts: dict[int, tuple[int, int]] | None) -> dict[int, np.ndarray]:
        return histograms(self.state, tree, parts, self.width, self.bins)

    def left(self) -> None:
        self.state.unpersist()


class _Cells:
    """Training with a score for each different row of bins; a round is one job."""

    def __init__(self, lists: DataFrame, cells: tuple[list[bytes], np.ndarray], width: int, bins: int, truncation: int, held_out: int) -> None:
        names, self.rows = cells
        self.table = np.frombuffer(b"".join(names), np.uint8).reshape(-1, width)
        self.bins, self.truncation, self.held_out, self.done = bins, truncation, held_out, 0
        self.scores = np.zeros(len(names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = {b: i for i, b in enumerate(names)}
            for batch in batches:
                own, at, _ = distinct_bins(np.frombuffer(_bytes(batch.column("bins")), np.uint8).reshape(-1, width))
                cell = np.array([number[b] for b in own], np.int64)[at]
                grade, size = np.frombuffer(_bytes(batch.column("grades")), np.float64), np.diff(_ends(batch.column("grades"))) // 8
                graded = np.logical_or.reduceat(grade != 0, np.cumsum(size) - size) if len(size) else np.zeros(0, bool)
                rows = np.repeat(graded, size)
                yield pa.RecordBatch.from_pydict({"held": batch.column("held").filter(pa.array(graded)), "cells": _lists(cell[rows], size[graded]), "grades": _lists(grade[rows], size[graded])})

        self.lists = stored(lists.mapInArrow(run, "held boolean, cells binary, grades binary"), "ranking-cells")

    def seen(self, trees: list[Tree]) -> dict[str, float | None]:
        if len(trees) - self.done >= STORE:
            self.scores, self.done = self._scores(trees), len(trees)
        scores, truncation, held_out = self._scores(trees), self.truncation, self.held_out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, seen = np.zeros((2, len(scores)), np.int64), np.zeros((2, len(AT)), np.int64)
            for batch in batches:
                cell, grade = (np.frombuffer(_bytes(batch.column(c)), t) for c, t in (("cells", np.int64), ("grades", np.float64)))
                size, held = np.diff(_ends(batch.column("grades"))) // 8, batch.column("held").to_numpy(zero_copy_only=False)
                start = np.cumsum(size) - size
                for n in np.unique(size):
                    own = np.flatnonzero(size == n)
                    for part in np.array_split(own, -(-len(own) * int(n) // LIST_CELLS) or 1):
                        at = start[part][:, None] + np.arange(n)[None, :]
                        fitted, asked = at[~held[part]], at[held[part]] if held_out else at
                        for kind, x in enumerate(gradients_of(grade[fitted], scores[cell[fitted]], truncation)):
                            # whole numbers in two halves, so that sums of doubles are exact
                            for scale, half in ((1 << 20, x >> 20), (1, x & 0xFFFFF)):
                                sums[kind] += np.bincount(cell[fitted].ravel(), half.ravel().astype(float), len(scores)).astype(np.int64) * scale
                        for i, k in enumerate(AT):
                            value = ndcg_of_lists(grade[asked], scores[cell[asked]], k)
                            value = value[~np.isnan(value)]
                            seen[:, i] += int(np.rint(value * UNIT).sum()), len(value)
            some = np.flatnonzero(sums.any(axis=0))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.append(some, -1 - np.arange(len(AT))).astype(np.int32)),
                **{c: pa.array(np.append(sums[i, some], seen[i])) for i, c in enumerate(("one", "two"))},
            })

        sums = self.lists.mapInArrow(run, "key int, one bigint, two bigint").groupBy("key").agg(F.sum("one").alias("one"), F.sum("two").alias("two"))
        self.sums = np.stack([np.zeros(len(scores), np.int64), np.zeros(len(scores), np.int64), self.rows])
        now: dict[str, float | None] = {f"ndcg{k}": None for k in AT}
        for r in sums.collect():  # a row a cell
            if r.key >= 0:
                self.sums[:2, r.key] = r.one, r.two
            elif r.two:
                now[f"ndcg{AT[-1 - r.key]}"] = r.one / UNIT / r.two
        return now

    def _scores(self, trees: list[Tree]) -> np.ndarray:
        return self.scores + sum((t.scores(self.table) for t in trees[self.done :]), np.zeros(len(self.scores)))

    def histograms(self, tree: Tree, parts: dict[int, tuple[int, int]] | None) -> dict[int, np.ndarray]:
        at, out = tree.nodes(self.table), {}
        for node in parts or [0]:
            own = at == node
            if parts is not None:
                own &= self.table[:, parts[node][0]] <= parts[node][1]
            out[node] = np.zeros((3, self.table.shape[1], self.bins), np.int64)
            for f in range(self.table.shape[1]):
                np.add.at(out[node][:, f].T, self.table[own, f], self.sums[:, own].T)
        return out

    def left(self) -> None:
        pass


def grow(engine: _Lists | _Cells, leaves: int, rate: float, min_rows: int) -> Tree | None:
    """One tree, leaf by leaf, the leaf of largest gain first (the older on ties)."""
    tree = Tree()
    hist = {0: engine.histograms(tree, None)[0]}
    best = {0: best_split(hist[0], min_rows)}
    halves: dict[int, np.ndarray] = {}
    while len(best) < leaves:
        able = [n for n in best if best[n]]
        if not able:
            break
        node = max(able, key=lambda n: (best[n][0], -n))
        if node not in halves:  # of all open leaves at once, as most will be split
            halves |= engine.histograms(tree, {n: best[n][1:] for n in able if n not in halves})
        _, feature, cut = best.pop(node)
        below = tree.split(node, feature, cut)
        lower = halves.pop(node)
        for child, own in zip(below, (lower, hist.pop(node) - lower), strict=True):
            hist[child], best[child] = own, best_split(own, min_rows)
    if len(best) == 1:
        return None
    for node in best:
        tree.value[node] = leaf_value(hist[node], rate)
    return tree


def fit(
    rows: DataFrame, features: list[str], *, query: str = "query_id", grade: str = "grade", rounds: int = ROUNDS, leaves: int = LEAVES, rate: float = RATE,
    min_rows: int = MIN_ROWS, truncation: int = TRUNCATION, bins: int = BINS, held_out: int = 5, patience: int = PATIENCE,
) -> Ranker:
    """Fit on ``rows`` (a query, a grade from 0 and ``features``).  One query in
    ``held_out`` (none if 0) is kept apart: training ends when the mean of its NDCG at
    1, 3 and 5 has not risen for ``patience`` rounds, and the best round's trees stay."""
    shares = [i / (bins + 1) for i in range(1, bins + 1)]
    found = rows.select(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features)).approxQuantile(features, shares, 0.001)
    edges = [sorted(set(e)) for e in found]
    width, n_bins = len(features), 1 + max(map(len, edges), default=0)
    lists = lists_of(rows, features, edges, query, grade, held_out)
    cells = cells_of(lists, width)
    engine = _Lists(lists, width, n_bins, truncation, held_out) if cells is None else _Cells(lists, cells, width, n_bins, truncation, held_out)
    trees: list[Tree] = []
    history: list[dict[str, float]] = []
    while True:
        history.append(engine.seen(trees))
        mean = [sum(x[f"ndcg{k}"] or 0.0 for k in AT) for x in history]
        kept = max(range(len(mean)), key=lambda i: (mean[i], -i))
        tree = grow(engine, leaves, rate, min_rows) if len(trees) < rounds and len(trees) - kept < patience else None
        engine.left()
        if tree is None:
            break
        trees.append(tree)
    return Ranker(features, edges, trees[:kept] if held_out else trees, history)


def ndcg_of(ranked: DataFrame, ks: tuple[int, ...] = AT) -> DataFrame:
    """Mean NDCG at each k of ``query_id, place`` (from 0), ``grade``: one row a k.
    Queries whose grades are all 0 are left out."""
    rows = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("grade").cast("double").alias("grade")))).alias("own"))
    gain = lambda g: F.pow(F.lit(2.0), g) - 1

    def dcg(grades: Column, k: Column) -> Column:
        each = F.transform(F.slice(grades, F.lit(1), k), lambda g, i: gain(g) / F.log2((i + 2).cast("double")))
        return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)

    own, best = F.col("own.grade"), F.sort_array(F.col("own.grade"), asc=False)
    each = rows.select("query_id", F.explode(F.array(*map(F.lit, ks))).alias("k"), own.alias("g"), best.alias("b"))
    value = dcg(F.col("g"), F.col("k")) / F.nullif(dcg(F.col("b"), F.col("k")), F.lit(0.0))
    return each.select("k", value.alias("v")).where("v IS NOT NULL").groupBy("k").agg(F.round(F.avg("v"), 6).alias("ndcg"), F.count("*").alias("n"))
