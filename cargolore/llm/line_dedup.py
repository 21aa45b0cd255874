"""Line deduplication against levelled sorted runs of line hashes.

The lines that a corpus is known to hold are kept as *runs*: tables of 128-bit
line hashes in ascending order, each row with the document that owns the line.
All runs of a store are bucketed by hash into the same number of files, each
sorted.  A new batch of documents is shuffled to these buckets and merge-anti-joined
with every run where it lies: no run is ever shuffled.  What is left is new and
becomes a run of level 0.  When a level has ``fanout`` runs, they are merged,
bucket by bucket, into one run of the next level, so a corpus of ``n`` batches has
at most ``fanout * log(n)`` runs.

Which runs a store has is said by its newest manifest, a small file that is written
aside and renamed.  A batch or a compaction that fails before that changes nothing,
and its files are never read; one that fails after it leaves old files that are
not read any more.

A line's key is the line without ASCII white space at its ends, with A-Z
lower-cased.  Keys of at least ``min_chars`` code points that are held by
several documents stay in the first document only: the earliest batch, and in a
batch the smallest ``doc_id``; all of that document's lines with the key stay.

Defined cases: a null or empty text is one empty line, kept; an id of null is a
document of its own kind that comes after all others; rows with equal ids are
one document for ownership and are all returned.  Empty tables give no rows.
Columns other than ``doc_id`` and ``text`` are passed on unread; a column with the
name of an added one is replaced.  Names that begin with two underscores are
reserved.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolore.llm.common import delete_path, hot_join, materialize, scratch_path

#: Code points that a key needs.
MIN_CHARS = 10
#: Batches into which one call cuts its documents, by ranges of ``doc_id``.
BATCHES = 3
#: Runs of a level that are compacted into one of the next; with 2 a merge needs no shuffle.
FANOUT = 2

_RUN = "h1 bigint, h2 bigint, owner bigint"
_KEYS = "h1 bigint, h2 bigint, doc_id bigint, part bigint"
#: Stands for a null id; it is larger than any id, so such rows own last.
_LAST = 2**63 - 1


def _lines(text: str | None, min_chars: int) -> list[tuple[bytes, bytes | None]]:
    """Each line with its hash, or with None if its key is too short."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip()
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            out.append((line, hashlib.blake2b(key.lower(), digest_size=16).digest()))
        else:
            out.append((line, None))
    return out


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1, h2, doc_id, part``: each key of each document, once a row of ``docs``.

    ``part`` tells texts without an id apart, so that none has to know what the others lose.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: list[bytes] = []
            owners: list[int] = []
            parts: list[int] = []
            for doc, part, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = {h for _, h in _lines(text, min_chars) if h}
                hashes += own
                owners += [doc] * len(own)
                parts += [part] * len(own)
            both = pa.Array.from_buffers(pa.int64(), 2 * len(hashes), [None, pa.py_buffer(b"".join(hashes))])
            yield pa.RecordBatch.from_arrays(
                [both.take(pa.array(range(0, len(both), 2), pa.int64())), both.take(pa.array(range(1, len(both), 2), pa.int64())), pa.array(owners, pa.int64()), pa.array(parts, pa.int64())],
                names=["h1", "h2", "doc_id", "part"],
            )

    return docs.select(*_named(docs), "text").mapInArrow(run, _KEYS)


def _named(docs: DataFrame) -> list[Column]:
    """A document's number and, where it has none, its text's hash."""
    number = F.col("doc_id").cast("long")
    return [F.coalesce(number, F.lit(_LAST)).alias("doc_id"), F.when(number.isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("part")]


class LineRuns:
    """The runs under one folder of a store that all executors reach.

    A new store gets ``buckets`` buckets, by default as many as the session has
    shuffle partitions; an old one keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._tables: dict[str, str] = {}
        self.buckets = self._manifest()[1] or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _manifest(self) -> tuple[int, int | None, list[tuple[int, str]]]:
        """The newest manifest's number, the buckets, and (level, name) of each run."""
        found = self._fs.globStatus(self._fs_path(f"{self.path}/manifest/at=*")) or []
        number = max((int(x.getPath().getName()[3:]) for x in found), default=0)
        if not number:
            return 0, None, []
        lines = [r.value.split() for r in self.spark.read.text(f"{self.path}/manifest/at={number}").collect()]  # a line a run
        return number, int(next(b for a, b in lines if a == "buckets")), sorted((int(a), b) for a, b in lines if a != "buckets")

    def _publish(self, runs: list[tuple[int, str]]) -> None:
        """Make these the store's runs, all at once."""
        number = 1 + self._manifest()[0]
        aside = self._fs_path(f"{self.path}/manifest/_new-{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray("".join([f"buckets {self.buckets}\n", *(f"{a} {b}\n" for a, b in runs)]).encode()))
        out.close()
        if not self._fs.rename(aside, self._fs_path(f"{self.path}/manifest/at={number}")):
            raise RuntimeError(f"another process has written manifest {number} of {self.path}")

    def runs(self) -> list[tuple[int, str]]:
        """(level, name) of each run."""
        return self._manifest()[2]

    def _table(self, name: str) -> str:
        """A bucketed table over a run's files, known to this session only."""
        if name not in self._tables:
            table = f"cargolore_run_{uuid.uuid4().hex}"
            clause = f"USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            self.spark.sql(f"CREATE TABLE {table} ({_RUN}) {clause}")
            self._tables[name] = table
        return self._tables[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def close(self) -> None:
        """Forget the session's tables; the runs stay."""
        for table in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables = {}

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"run-{level}-{uuid.uuid4().hex}"
        rows.select("h1", "h2", "owner").write.insertInto(self._table(name))
        return name

    def add(self, new: DataFrame) -> None:
        """Make ``new`` (hashes that no run holds) a run of level 0; compact full levels."""
        name = self._write(new.repartition(self.buckets, "h1", "h2"), 0)
        self._publish([*self.runs(), (0, name)])
        level = 0
        while len(own := [x for x in self.runs() if x[0] == level]) >= self.fanout:
            merged = self.read(own[0][1])
            for _, other in own[1:]:
                right = self.read(other).withColumnRenamed("owner", "__owner")
                merged = merged.join(right, ["h1", "h2"], "full").select("h1", "h2", F.coalesce("owner", "__owner").alias("owner"))
            name = self._write(merged, level + 1)
            self._publish([*(x for x in self.runs() if x not in own), (level + 1, name)])
            for _, old in own:
                delete_path(self.spark, f"{self.path}/{old}")
            level += 1

    def known(self) -> DataFrame:
        """All runs as one table; their hashes are distinct."""
        out = self.spark.createDataFrame([], _RUN)
        for _, name in self.runs():
            out = out.unionByName(self.read(name))
        return out

    def owners(self, keys: DataFrame) -> DataFrame:
        """``keys`` (each ``h1, h2`` once) with ``owner``, null where no run holds it.
        One merge join a run; only ``keys`` move."""
        found = []
        for i, (_, name) in enumerate(self.runs()):
            keys = keys.join(self.read(name).withColumnRenamed("owner", f"__owner{i}"), ["h1", "h2"], "left")
            found.append(f"__owner{i}")
        none = F.lit(None).cast("long")
        return keys.withColumn("owner", F.coalesce(*found, none) if found else none).drop(*found)


def add_batch(runs: LineRuns, keys: DataFrame) -> DataFrame:
    """Put a batch's ``keys`` against the runs and add the new ones.

    Returns ``doc_id, part, h1, h2``: the keys that their documents lose.  It is
    written before the batch's run, so a batch that is tried again after a
    failure gives the same result.
    """
    first = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    owned = runs.owners(first).withColumn("new", F.col("owner").isNull()).withColumn("owner", F.coalesce("owner", "first"))
    owned = materialize(owned, "batch-lines")
    shared = owned.where(~F.col("new") | (F.col("first") < F.col("last"))).select("h1", "h2", "owner", "n")
    lost = hot_join(keys, shared, ["h1", "h2"], "n", F.xxhash64("doc_id")).where("doc_id <> owner").select("doc_id", "part", "h1", "h2")
    lost = materialize(lost, "lost-lines")
    runs.add(owned.where("new"))
    return lost


def drop_lines(docs: DataFrame, lost: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (any columns) with ``text`` rebuilt without the lost keys, and
    ``n_lines`` (before) and ``n_dropped``.  Column names are kept as they are.
    """
    packed = F.concat(*(F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("h1", "h2")))
    own = lost.select(F.col("doc_id").alias("__doc"), F.col("part").alias("__part"), packed.alias("__h"))
    own = own.groupBy("__doc", "__part").agg(F.collect_set("__h").alias("__lost"))
    joined = docs.withColumns(dict(zip(("__doc", "__part"), _named(docs), strict=True))).join(own, ["__doc", "__part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts, before, dropped = [], [], []
            for text, gone in zip(table["text"].to_pylist(), table["__lost"].to_pylist(), strict=True):
                if not gone:
                    texts.append(text)
                    before.append((text or "").count("\n") + 1)
                    dropped.append(0)
                    continue
                # a hash is stored as two little-endian numbers, written out big-endian
                gone = {x[7::-1] + x[15:7:-1] for x in gone}
                lines = _lines(text, min_chars)
                kept = [line for line, h in lines if h not in gone]
                texts.append(b"\n".join(kept).decode())
                before.append(len(lines))
                dropped.append(len(lines) - len(kept))
            at = table.schema.get_field_index("text")
            table = table.drop_columns(["__lost"]).set_column(at, "text", pa.array(texts, pa.string()))
            table = table.append_column("n_lines", pa.array(before, pa.int64())).append_column("n_dropped", pa.array(dropped, pa.int64()))
            yield from table.combine_chunks().to_batches()

    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = docs.select(*kept).withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema
    return joined.select(*kept, "__lost").mapInArrow(run, out)


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, batches: int = BATCHES, path: str | None = None, fanout: int = FANOUT) -> DataFrame:
    """Remove repeated lines within ``docs`` and against the runs under ``path``.

    ``docs`` are put in ``batches`` ranges of ``doc_id`` of about equal size (the
    ranges' bounds come from approximate quantiles of all ids, and only say which
    batch goes first: the result is the same for any number of batches).  With a
    ``path``, its runs stay for later calls; without, they are scratch.
    Returns ``docs`` with ``text`` reduced, ``n_lines`` and ``n_dropped``.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, path or scratch_path(spark, "runs"), fanout)
    keys = materialize(line_keys(docs, min_chars), "line-keys")
    bounds = keys.where(F.col("doc_id") < _LAST).approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    bounds = sorted({int(b) for b in bounds})
    lost = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        own = keys
        if low is not None:
            own = own.where(F.col("doc_id") >= low)
        if high is not None:
            own = own.where(F.col("doc_id") < high)
        gone = add_batch(runs, own)
        lost = gone if lost is None else lost.unionByName(gone)
    runs.close()
    if path is None:
        delete_path(spark, runs.path)
    return drop_lines(docs, lost, min_chars)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the contract's columns for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, i, w[i] AS line,
                  translate(trim(w[i], e' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, string_split(coalesce(text, ''), e'\n') AS w FROM documents), unnest(range(1, len(w) + 1)) AS u(i)),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, e'\n' ORDER BY i) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN o USING (k) GROUP BY doc_id
"""
