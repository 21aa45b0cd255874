"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to), so the flow problem has a node for each pattern and for each source, not
for each document.  A pattern supplies its words up to ``max_repeats`` times;
the k-th copy of a word costs k (k - 1) / 2, so costs are convex and a word is
only repeated when no unused word can serve.  The flow's totals are then drawn
from the pattern's documents in a seeded order: whole rounds for all, and one
more copy for the first documents of the order until the rest is used up.

Targets are shares by weight, found by raising the level at which sources that
cannot reach it stop; each step is one aggregation over the table of sources.  A
source whose documents belong to it alone needs no flow: it takes its target.
Only sources that share documents are solved as a flow, each connected group of
them in a task of its own (a group has a row for each pattern, not for each
document; groups are solved in parallel).  Nothing is collected to the driver.

The order is cut into buckets by hash; bucket totals locate the bucket where
the rest ends, and only that bucket's documents are put in order.  Buckets grow
in number with the documents, so no task holds a pattern whole.

Defined cases: a null or empty text has size 0 and is never taken; a source of
null is a source, the last one; a document without any source (an empty array) is
never taken; rows with equal ids are taken or left each on
its own, but alike if their texts are equal in size; an empty table gives no
rows.  Other columns are passed on unread; a column with the name of an added one
is replaced.  Names that begin with two underscores are reserved.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargolore.llm.common import hot_join, materialize, n_words
from cargolore.llm.components import components

#: No document is taken more often than this.
MAX_REPEATS = 3
SEED = 42
#: Buckets of a pattern's seeded order, at least, and documents of a bucket, about.
BUCKETS, BUCKET_DOCS = 4096, 50_000
#: A plan of up to so many patterns is sent to all executors; a larger one is joined.
BROADCAST_PATTERNS = 100_000


def route(patterns: list[tuple[int, list[int]]], quotas: dict[int, int], max_repeats: int = MAX_REPEATS) -> list[int]:
    """Min-cost max-flow from patterns (words, sources) to sources: the words taken
    of each pattern.

    Every path's cost is that of the copy it starts with, so the cheapest flow is
    reached copy by copy: the capacity of each pattern grows by its words, and the
    flow is made maximal again (by blocking flows) before the next copy opens.
    """
    numbers = {q: 2 + len(patterns) + i for i, q in enumerate(quotas)}
    head: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(numbers))]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, size: int) -> int:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((size, 0))
        return len(to) - 2

    supply = []
    for i, (size, sources) in enumerate(patterns):
        supply.append(arc(0, 2 + i, 0))
        for q in sources:
            arc(2 + i, numbers[q], size * max_repeats)
    for q, quota in quotas.items():
        arc(numbers[q], 1, quota)
    for _ in range(max_repeats):
        for a, (size, _) in zip(supply, patterns, strict=True):
            room[a] += size
        while True:
            level = [-1] * len(head)
            level[0], queue = 0, deque([0])
            while queue:
                a = queue.popleft()
                for e in head[a]:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        queue.append(to[e])
            if level[1] < 0:
                break
            turn, path, at = [0] * len(head), [], 0
            while True:
                if at == 1:
                    push = min(room[e] for e in path)
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    path, at = [], 0
                elif turn[at] < len(head[at]):
                    e = head[at][turn[at]]
                    if room[e] and level[to[e]] == level[at] + 1:
                        path.append(e)
                        at = to[e]
                    else:
                        turn[at] += 1
                elif path:
                    at = to[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break
    return [room[a ^ 1] for a in supply]


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: their place (from 0) by ``column``, by code point,
    null last.  Ranges are ordered each on its own; only their sizes are summed up."""
    nulls = F.col(column).isNull().cast("int")
    ranged = rows.withColumn("__null", nulls).repartitionByRange("__null", column).withColumn("__range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sizes = sorted((r["__range"], r["n"]) for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).collect())  # a row a partition
    starts = F.create_map(*(F.lit(x) for i, (p, _) in enumerate(sizes) for x in (p, sum(n for _, n in sizes[:i])))) if sizes else F.create_map(F.lit(0), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__null", column)) - 1
    return ranged.withColumn(name, (starts[F.col("__range")] + inside).cast("long")).drop("__null", "__range")


def source_targets(totals: DataFrame, weights: DataFrame | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, number, source_size, weight, target`` from ``pattern, n``.

    ``weights`` has ``source, weight``; without it weights are 1, 2, 3, repeating,
    by code point, null last.  All words, counted once, are shared by weight; no
    source gets above ``max_repeats`` times its size, what is left is shared again.
    """
    sizes = totals.select(F.explode("pattern").alias("source"), "n").groupBy("source").agg(F.sum("n").cast("long").alias("source_size"))
    sources = numbered(sizes, "source", "number")
    if weights is None:
        sources = sources.withColumn("weight", (1 + F.col("number") % 3).cast("double"))
    else:
        named = weights.select(F.col("source").alias("__named"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(named, F.col("source").eqNullSafe(F.col("__named")), "left").drop("__named").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sources = materialize(sources, "sources")
    most = max_repeats * F.col("source_size")
    once = int(totals.agg(F.sum("n")).first()[0] or 0)
    open_weight, stopped, level, left = float(sources.agg(F.sum("weight")).first()[0] or 0.0), -1, 0.0, once
    while open_weight > 0:
        level = left / open_weight
        low = most < level * F.col("weight")
        n, taken, rest = sources.agg(F.count_if(low), F.sum(F.when(low, most)), F.sum(F.when(~low, F.col("weight")))).first()
        if n == stopped:
            break
        stopped, left, open_weight = n, once - int(taken or 0), float(rest or 0.0)
    return sources.withColumn("target", F.least(most.cast("double"), F.lit(level) * F.col("weight")))


def _solve(max_repeats: int):  # noqa: ANN202
    def run(patterns: pa.Table, sources: pa.Table) -> pa.Table:
        quotas = dict(zip(sources["number"].to_pylist(), sources["quota"].to_pylist(), strict=True))
        # several flows may be cheapest: the order by sources, not by arrival, makes reruns agree
        rows = sorted(zip(patterns["numbers"].to_pylist(), patterns["n"].to_pylist(), patterns["pno"].to_pylist(), strict=True))
        words = route([(n, numbers) for numbers, n, _ in rows], dict(sorted(quotas.items())), max_repeats)
        return pa.table({"pno": pa.array([pno for *_, pno in rows], pa.int64()), "words": pa.array(words, pa.int64())})

    return run


def pattern_words(totals: DataFrame, sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``pno, words``: the words that the mix takes of each pattern (``pno, pattern,
    n``; without sources: none)."""
    quota = F.bround("target", 0).cast("long")
    own = totals.select("pno", "n", F.explode("pattern").alias("__source"))
    own = own.join(sources.select("source", "number", quota.alias("quota")), F.col("__source").eqNullSafe(F.col("source"))).select("pno", "n", "number", "quota")
    own = materialize(own, "memberships")
    sets = own.groupBy("pno").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("number")).alias("numbers"), F.max("quota").alias("quota"))
    sets = materialize(sets, "sets")
    shared = sets.where(F.size("numbers") > 1)
    simple = F.least(F.col("quota"), max_repeats * F.col("n")).alias("words")
    if shared.isEmpty():
        return sets.select("pno", simple)
    links = shared.select(F.col("numbers")[0].alias("u"), F.explode(F.slice("numbers", 2, F.size("numbers"))).alias("v"))
    groups = materialize(components(links), "source-groups")
    by_first = sets.withColumn("__first", F.col("numbers")[0]).join(groups, F.col("__first") == F.col("node"), "left")
    alone = by_first.where("component IS NULL").select("pno", simple)
    patterns = by_first.where("component IS NOT NULL").select("component", "pno", "n", "numbers")
    quotas = own.select("number", "quota").distinct().join(groups, F.col("number") == F.col("node")).select(F.col("component").alias("group"), "number", "quota")
    solved = patterns.groupBy("component").cogroup(quotas.groupBy("group")).applyInArrow(_solve(max_repeats), "pno bigint, words bigint")
    return alone.unionByName(solved)


def _mixed(docs: DataFrame, sources: str | Column, weights: DataFrame | None, max_repeats: int, seed: int, id_column: str, size: Column) -> DataFrame:
    """``docs`` with ``size, pattern, repeats, taken``, and of documents with one
    source its ``__source_size`` and ``__target``."""
    source = F.col(sources) if isinstance(sources, str) else sources
    is_list = docs.select(source.alias("s")).schema["s"].dataType.typeName() == "array"
    pattern = F.array_sort(F.array_distinct(F.coalesce(source, F.array().cast("array<string>")))) if is_list else F.array(source.cast("string"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")))
    sized = docs.withColumns({"size": size, "pattern": pattern, "__order": order})
    totals = sized.groupBy("pattern").agg(F.sum("size").cast("long").alias("n"), F.count("*").alias("m")).withColumn("pno", F.monotonically_increasing_id())
    totals = materialize(totals, "patterns")
    n_patterns, n_docs = totals.agg(F.count("*"), F.sum("m")).first()
    n_buckets = max(BUCKETS, -(-(n_docs or 0) // BUCKET_DOCS))
    sized = sized.withColumn("__bucket", (F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") * n_buckets / 2**32).cast("int"))
    known = source_targets(totals, weights, max_repeats)
    words = pattern_words(totals, known, max_repeats)
    some = F.col("n") > 0
    plan = totals.join(words, "pno", "left").select(
        F.col("pattern").alias("__pattern"), F.col("m").alias("__m"),
        F.when(some, F.floor(F.col("words") / F.col("n"))).otherwise(0).cast("long").alias("__rounds"), F.when(some, F.col("words") % F.col("n")).otherwise(0).alias("__rest"),
        F.when(F.size("pattern") == 1, F.struct(F.col("pattern")[0].alias("s"))).alias("__one"),
    )
    told = known.select(F.struct(F.col("source").alias("s")).alias("__key"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    plan = materialize(plan.join(told, plan["__one"].eqNullSafe(told["__key"]), "left").drop("__one", "__key"), "plan")
    buckets = sized.groupBy("pattern", "__bucket").agg(F.sum("size").alias("__n"))
    running = F.sum("__n").over(Window.partitionBy("pattern").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    edges = (
        buckets.withColumn("__before", F.coalesce(running, F.lit(0))).join(plan.select("__pattern", "__rest"), F.col("pattern") == F.col("__pattern"))
        .where((F.col("__before") <= F.col("__rest")) & (F.col("__rest") < F.col("__before") + F.col("__n")))
        .groupBy("pattern").agg(F.min("__bucket").alias("__edge"), F.min_by("__before", "__bucket").alias("__until"))
    )  # at most a row a pattern
    plan = materialize(plan.join(edges, F.col("pattern") == F.col("__pattern"), "left").drop("pattern").withColumnRenamed("__pattern", "pattern"), "plan-edges")
    if n_patterns <= BROADCAST_PATTERNS:
        placed = sized.join(F.broadcast(plan), "pattern", "left")
    else:
        placed = hot_join(sized, plan, ["pattern"], "__m", F.xxhash64("__order"), "left")
    on_edge = F.coalesce(F.col("__bucket") == F.col("__edge"), F.lit(False))
    inside = Window.partitionBy("pattern", "__bucket").orderBy("__order", id_column, "size").rowsBetween(Window.unboundedPreceding, 0)
    edge_rows = placed.where(on_edge).withColumn("__upto", F.col("__until") + F.sum("size").over(inside))
    # a document is taken once more if at least half of it fits in the rest
    extra = (2 * F.col("__upto") - F.col("size") <= 2 * F.col("__rest")).cast("long")
    rest_rows = placed.where(~on_edge).withColumn("__more", F.coalesce((F.col("__bucket") < F.col("__edge")).cast("long"), F.lit(0)))
    both = edge_rows.withColumn("__more", extra).drop("__upto").unionByName(rest_rows)
    once_more = F.when(F.col("__rest") > 0, F.col("__more")).otherwise(0)
    repeats = F.when(F.col("size") > 0, F.least(F.lit(max_repeats), F.coalesce("__rounds", F.lit(0)) + once_more)).otherwise(0)
    return both.withColumn("repeats", repeats.cast("long")).withColumn("taken", F.col("repeats") * F.col("size"))


def mix(
    docs: DataFrame,
    sources: str | Column = "source",
    weights: DataFrame | None = None,
    *,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: Column | None = None,
) -> DataFrame:
    """``docs`` with ``size``, ``pattern``, ``repeats`` (how often the mix takes
    the document) and ``taken`` (words).

    ``sources`` names one source a row, or an array of sources for documents that
    belong to several; ``weights`` is a table ``source, weight`` (sources that it
    does not name weigh nothing), by default 1, 2, 3, repeating.  Sizes (words of
    the text, or ``size``) are summed over all rows.
    """
    out = _mixed(docs, sources, weights, max_repeats, seed, id_column, n_words(F.col(text_column)) if size is None else size)
    return out.select(*(c for c in docs.columns if c not in ("size", "pattern", "repeats", "taken")), "size", "pattern", "repeats", "taken")


def mix_query(docs: DataFrame) -> DataFrame:
    """op10's columns for ``docs`` with ``doc_id, text, source``."""
    # words are counted once; the passes that follow read sizes only
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("n")), "sizes")
    mixed = _mixed(sized, "source", None, MAX_REPEATS, SEED, "doc_id", F.col("n"))
    return mixed.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "taken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the contract's columns for every document."""
    return mix_query(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def memberships(docs: DataFrame) -> DataFrame:
    """``doc_id, n, sources``: documents that belong to their source and, if they
    name a language, to the collection of that language."""
    own = F.filter(F.array(F.concat(F.lit("source:"), F.coalesce("source", F.lit("none"))), F.concat(F.lit("language:"), "lang")), lambda s: s.isNotNull())
    return docs.select("doc_id", n_words(F.col("text")).alias("n"), own.alias("sources"))


def overlap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of overlapping sources, mixed by the flow: ``doc_id, size, pattern,
    repeats, taken``."""
    sized = materialize(memberships(spark.read.parquet(f"{sf_dir}/documents.parquet")), "memberships")
    mixed = mix(sized, "sources", size=F.col("n"))
    return mixed.select("doc_id", "size", F.array_join("pattern", ",").alias("pattern"), "repeats", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('42:' || doc_id) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
r AS (SELECT *, sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY 3 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM s),
l AS (SELECT max(rest::DOUBLE / weight) AS level FROM (SELECT * FROM r WHERE 3 * n >= rest::DOUBLE / weight * w ORDER BY 3 * n / w, source LIMIT 1)),
t AS (SELECT source, n, least(3.0 * n, l.level * w)::DOUBLE AS target FROM s, l),
q AS (SELECT *, round_even(target, 0)::BIGINT AS x FROM t),
c AS (SELECT d.*, q.n, q.target, q.x // greatest(q.n, 1) AS k, q.x % greatest(q.n, 1) AS m,
             sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, n AS source_size, target,
       (size * CASE WHEN size > 0 THEN least(3, k + CASE WHEN m > 0 AND 2 * upto - size <= 2 * m THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken
FROM c
"""
