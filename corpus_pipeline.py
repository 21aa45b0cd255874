"""A corpus pipeline: five stages over ``documents``, each one of the operators
of ``cargolore.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.

Defined cases: documents without an accepted language go, so null and empty texts and
texts without letters do; a null id is one document's for line ownership, comes last
where a group chooses who stays, and is passed on; rows that repeat an id are rows of
their own (equal texts form a group, of which one stays); an empty table gives an empty
mix.  Each stage reads Parquet files, whose rows it can number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolore.llm.common import materialize, numbered
from cargolore.llm.decontaminate import decontaminate
from cargolore.llm.jaccard_join import jaccard_join
from cargolore.llm.language_id import identify
from cargolore.llm.line_dedup import dedup_lines
from cargolore.llm.mixing import mix_query


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without an accepted language go."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text", "source")
    found = identify(packed, docs.select("doc_id", "text", "lang"), host=F.col("source"), keep=("row",), key="doc_id")
    return found.where("accepted").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines held by an earlier document go, and ``n_chars`` follows."""
    rest = F.struct(*(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))).alias("row")
    kept = dedup_lines(docs.select("doc_id", "text", rest))
    values = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return kept.select(*(values.get(c, F.col("row")[c].alias(c)) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group the row of smallest id stays (of equal ids,
    and of rows that have none and come last, one of them).  Rows are told by their
    numbers, as ids may be null or repeated."""
    rows = numbered(docs)
    found = jaccard_join(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("__row").alias("row"))
    first = rows.select("__row", order.alias("order")).join(found, "__row").groupBy("class_id").agg(F.min("order").alias("order"))
    return rows.join(first.select(F.col("order.row").alias("__row")), "__row", "left_semi").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: contaminated documents go.  Rows are told by their numbers, as
    ids may be null or repeated."""
    rows = numbered(docs)
    found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row="__row")
    gone = found.where("contaminated").select(F.col("row").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: how many words of each document the mix takes."""
    return mix_query(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontaminate", benchmark),
    ("mixing", mixing),
]

#: Language ID is a fitted model and the join's pruning is probabilistic, so the
#: whole has no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
