"""Helpers that several corpus operators share: scratch tables, words, hashes.

Words and lines are hashed inside Python tasks with numpy over whole Arrow
buffers.  All hashes are fixed functions of the bytes, so a retried task, or
another executor, computes the same values.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task hashes at once (a longer text is hashed alone).
CHUNK_BYTES = 2_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55
_STEP = 0xD6E8FEB86659FD93


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set,
    else, in local mode only, one of this machine's own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cargolore-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{scratch_dir(spark)}/cargolore/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there,
    so a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str = "__row") -> DataFrame:
    """``docs``, read from Parquet, with a number for each row that every reading gives
    again: of the row's file, and of its place there.  Other rows are written first.

    The driver numbers the files, of which it has a list anyway.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
        files = sorted(r[0] for r in placed.select("__file").distinct().collect())
    except AnalysisException:  # not rows of files
        return numbered(materialize(docs, "rows"), name)
    table = docs.sparkSession.createDataFrame(list(enumerate(files)), "__number bigint, __file string")
    found = placed.join(F.broadcast(table), "__file")
    return found.select(*docs.columns, (F.shiftleft("__number", 36) + F.col("__place")).alias(name))


#: Keys with more rows than this, and than a thousandth of all, are hot.
HOT_ROWS = 512


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: Column, how: str = "inner", total: int | None = None) -> DataFrame:
    """Join ``left`` with ``right``, which has each key once and in ``weight`` how
    many rows ``left`` has of it, without a hot key landing in one task.

    ``total`` may give the sum of weights, or more, where it is known.
    A key's rows are split by ``spread`` (a fixed hash of the row) into parts of
    at most ``HOT_ROWS`` rows or a thousandth of all, and its row of ``right`` is
    repeated for each part.  Hot keys are fewer than a thousand by that bound, so
    they are broadcast.
    """
    total = (right.agg(F.sum(weight)).first()[0] or 0) if total is None else total
    limit = max(HOT_ROWS, -(-total // 1000))
    parts = F.greatest(F.lit(1), F.ceil(F.col(weight) / limit)).cast("int")
    hot = right.where(F.col(weight) > limit).select(*(F.col(k).alias(f"__hot_{k}") for k in keys), parts.alias("__parts"))
    met = [left[k] == F.col(f"__hot_{k}") for k in keys]
    salted = left.join(F.broadcast(hot), met, "left").drop(*(f"__hot_{k}" for k in keys))
    salted = salted.withColumn("__salt", F.coalesce(F.pmod(spread, F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    each = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted.join(each, [*keys, "__salt"], how).drop("__salt")


def as_docs(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with only the named columns (``doc_id`` and ``text`` by default)."""
    return docs.select(*(columns or ("doc_id", "text")))


def trim_ascii(text: Column) -> Column:
    """``text`` without ASCII white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.  (A column that a lambda function
    reads may be put in its place and then be computed for each element.)"""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    """The number of runs of other characters than ASCII white space."""
    body = trim_ascii(F.coalesce(text, F.lit("")))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, "[\\x20\\x09-\\x0D]+"))).cast("long")


def byte_class(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, what it is read as, and whether it belongs to a word.

    ``plain``: words are runs of anything but ASCII white space, unchanged.
    ``folded``: A-Z is lower-cased; words are runs of 0-9, a-z and non-ASCII.
    """
    read = np.arange(256, dtype=np.uint8)
    if kind == "plain":
        word = np.ones(256, dtype=bool)
        word[[0x20, *range(0x09, 0x0E)]] = False
        return read, word
    read[0x41:0x5B] += 0x20
    word = read >= 0x80
    word[0x30:0x3A] = True
    word[0x61:0x7B] = True
    word[0x41:0x5B] = True
    return read, word


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and where each text ends (nulls are empty)."""
    filled = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(filled, pa.ChunkedArray):
        filled = pa.concat_arrays(filled.chunks) if filled.num_chunks else pa.array([], pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if len(filled) == 0 or filled.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(filled), np.int64)
    data = np.frombuffer(filled.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def chunks(ends: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes, one text at least."""
    first = 0
    while first < len(ends):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield first, last
        first = last


class Words:
    """The words of a range of texts: hashes, byte ranges, and counts by text."""

    __slots__ = ("hashes", "starts", "ends", "counts")

    def __init__(self, data: np.ndarray, ends: np.ndarray, kind: str) -> None:
        """``data``: the texts' bytes one after the other; ``ends``: of each text."""
        read, is_word = byte_class(kind)
        inside = is_word[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[ends] = True
        cut[0] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        self.starts = np.flatnonzero(inside & (~before | cut[:-1]))
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        lengths = self.ends - self.starts
        if len(lengths):
            at = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
            value = read[data[inside]].astype(np.uint64) + _U(1)
            value *= _powers(int(lengths.max()))[place]
            hashes = np.add.reduceat(value, at) + lengths.astype(np.uint64) * _U(_STEP)
            self.hashes = mix(hashes)
        else:
            self.hashes = np.zeros(0, np.uint64)
        self.counts = np.diff(np.searchsorted(self.starts, np.concatenate([[0], ends])))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` words, by doubling; ``len - k + 1`` values."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    out, have, bits, size = np.zeros(n, np.uint64), 0, hashes, 1
    while True:
        if k & size:
            piece = bits[have : have + n]
            out = out * _U(pow(_STEP, size, 1 << 64)) + piece if have else piece.copy()
            have += size
        if have == k:
            return mix(out)
        bits = bits[:-size] * _U(pow(_STEP, size, 1 << 64)) + bits[size:]
        size *= 2


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
