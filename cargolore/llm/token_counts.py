"""Token totals that signed deltas keep up to date.

A change set has rows ``doc_id, source, lang, tokenizer, n_docs, n_tokens`` with
signs: ``+1, +n`` for an insert, ``-1, -n`` for a delete, and for a revised count
a row that takes the old figures back and one that adds the new.  A batch's
changes are summed by source, language and tokenizer version and written as one
delta table under ``deltas/batch=ID`` (the id escaped as in addresses).  Totals
are sums of deltas, so they are additive in any order; committing a batch again
overwrites its delta by the same rows, so a retried or repeated commit changes
nothing.  ``compact`` folds the deltas that one listing shows into a new base
and writes their ids beside it; deltas with such an id count no more, whether or
not they have been deleted yet.  One process compacts at a time; others may
commit meanwhile.

A ledger of each document's current figures (``ledger_changes``) turns whole
documents into signed changes: the difference between what is recorded and what
is.

Defined cases: a null text has no tokens but is a document; sources and
languages of null are groups; rows with equal ids in one insert batch count each
on their own; groups whose totals have come to zero are left out; empty change
sets commit an empty delta; any text is a batch id but the empty one.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolore.llm.common import delete_path, materialize, n_words, scratch_path

#: A byte-level BPE vocabulary in tiktoken's format: where the query finds it if
#: the session does not set ``spark.cargolore.vocabulary``.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The query's passing policy: documents of fewer tokens are deleted and restored.
SHORT_TOKENS = 50
#: How that vocabulary's texts are cut before merging (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "tokenizer")
#: Pieces whose token counts a task remembers.
_MEMO = 200_000


def bpe_counts(texts: list[str | None], encoding, memo: dict, cut) -> list[int]:  # noqa: ANN001
    """Tokens of each text; the counts of short pieces are remembered."""
    out = []
    for text in texts:
        n = 0
        for piece in cut(text or ""):
            k = memo.get(piece)
            if k is None:
                k = len(encoding.encode_ordinary(piece))
                if len(memo) < _MEMO and len(piece) <= 24:
                    memo[piece] = k
            n += k
        out.append(n)
    return out


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, version: str = "byte-bpe-50k") -> DataFrame:
    """``doc_id, source, lang, tokenizer, n_docs, n_tokens``: two rows a document,
    one by white space (``words``) and one by the vocabulary (``version``), a file
    that the driver reads."""
    if not os.path.exists(vocabulary):
        raise FileNotFoundError(f"no vocabulary at {vocabulary}: pass vocabulary=, or set spark.cargolore.vocabulary for the query")
    with open(vocabulary, "rb") as f:  # the driver's own file, sent to the tasks by value
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), n_words(F.col("text")).alias("words"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        cut, memo = regex.compile(PATTERN).findall, {}
        for batch in batches:
            n = pa.array(bpe_counts(batch.column("text").to_pylist(), encoding, memo, cut), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [n], names=["doc_id", "source", "lang", "words", "bpe"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = base.mapInArrow(run, f"doc_id {id_type}, source string, lang string, words bigint, bpe bigint")
    each = F.explode(F.array(F.struct(F.lit("words").alias("t"), F.col("words").alias("n")), F.struct(F.lit(version).alias("t"), F.col("bpe").alias("n"))))
    return counted.select("doc_id", "source", "lang", each.alias("c")).select(
        "doc_id", "source", "lang", F.col("c.t").alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.col("c.n").alias("n_tokens")
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """The rows of ``count_tokens`` by white space alone, by SQL functions."""
    one = F.lit(1).cast("long").alias("n_docs")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit("words").alias("tokenizer"), one, n_words(F.col("text")).alias("n_tokens"))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counted documents as inserts (``sign`` 1) or deletes (-1)."""
    return counts.select(*KEYS, (sign * F.col("n_docs")).alias("n_docs"), (sign * F.col("n_tokens")).alias("n_tokens"))


def ledger_changes(ledger: DataFrame, current: DataFrame) -> DataFrame:
    """Signed changes that lead from ``ledger`` to ``current`` (both with the
    columns of ``count_tokens``): inserts, deletes, and for a revised count one
    row with the difference.  What is the same in both cancels out."""
    names = ["doc_id", *KEYS, "n_docs", "n_tokens"]
    taken = ledger.select(*names[:4], (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
    both = current.select(*names).unionByName(taken)
    return both.groupBy("doc_id", *KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")


class TokenRollup:
    """The totals under one folder of a store that all executors reach."""

    _SUMS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        """Names of the finished tables in a folder of the store."""
        done = self._fs.globStatus(self._jvm_path(f"{self.path}/{folder}/*/_SUCCESS")) or []
        return sorted(x.getPath().getParent().getName() for x in done)

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Commit a batch's signed changes under its id; repeating it is harmless,
        also after the batch has been folded into the base."""
        if not batch:
            raise ValueError("a batch needs an id")
        delta = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        delta.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={quote(batch, safe='')}")

    def _state(self) -> tuple[str | None, list[str]]:
        """The newest base and the deltas, from one listing (deltas first: a base
        that is published in between has folded them, which its ids tell)."""
        deltas = self._names("deltas")
        return max(self._names("base"), default=None), deltas

    def _sums(self, base: str | None, deltas: list[str]) -> DataFrame:
        """The totals of a base and of the deltas that it has not folded."""
        rows = self.spark.read.schema(self._SUMS).parquet(f"{self.path}/base/{base}") if base else self.spark.createDataFrame([], self._SUMS)
        if deltas:
            fresh = self.spark.read.schema(f"{self._SUMS}, batch string").parquet(*(f"{self.path}/deltas/{d}" for d in deltas))
            if base:
                folded = self.spark.read.schema("batch string").parquet(f"{self.path}/folded/{base}")
                fresh = fresh.join(folded, "batch", "left_anti")
            rows = rows.unionByName(fresh.drop("batch"))
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` over all commits."""
        return self._sums(*self._state())

    def compact(self) -> None:
        """Fold the deltas of one listing into a new base.  The base counts from
        the moment its ``_SUCCESS`` is there; a compaction that fails before
        changes nothing, one that fails after leaves deltas that count no more."""
        base, deltas = self._state()
        number = f"{1 + int(base or 0):08d}"
        ids = self.spark.createDataFrame([(unquote(d.removeprefix("batch=")),) for d in deltas], "batch string")
        if base:
            ids = ids.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/folded/{base}")).distinct()
        ids.write.mode("overwrite").parquet(f"{self.path}/folded/{number}")
        self._sums(base, deltas).write.mode("overwrite").parquet(f"{self.path}/base/{number}")
        for d in deltas:
            delete_path(self.spark, f"{self.path}/deltas/{d}")


def rolled_up(counts: DataFrame) -> DataFrame:
    """The totals of ``counts`` through a store's life: a first delivery counts
    each document as one token less than it has; the counts are revised; documents
    of under ``SHORT_TOKENS`` tokens are deleted; the deltas are compacted and the
    deletion is committed again, which changes nothing; the documents return."""
    spark = counts.sparkSession
    counts = materialize(counts, "token-counts")
    first = counts.withColumn("n_tokens", F.greatest(F.col("n_tokens") - 1, F.lit(0)))
    short = counts.where(F.col("n_tokens") < SHORT_TOKENS)
    rollup = TokenRollup(spark, scratch_path(spark, "tokens"))
    rollup.commit("delivery", signed(first, 1))
    rollup.commit("revision", signed(counts, 1).unionByName(signed(first, -1)))
    rollup.commit("deletion", signed(short, -1))
    rollup.compact()
    rollup.commit("deletion", signed(short, -1))
    rollup.commit("return", signed(short, 1))
    return rollup.totals()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: ``source, lang, tokenizer, n_docs, n_tokens`` of all documents, kept
    by inserts, revisions and deletes (:func:`rolled_up`)."""
    vocabulary = spark.conf.get("spark.cargolore.vocabulary", VOCABULARY)
    return rolled_up(count_tokens(_documents(spark, sf_dir), vocabulary))


def words_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same store with the counts by white space alone, which SQL can express."""
    return rolled_up(word_counts(_documents(spark, sf_dir)))


WORDS_SQL = r"""
SELECT source, lang, 'words' AS tokenizer, count(*) AS n_docs, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens
FROM documents GROUP BY source, lang
"""
