"""Retrieval of candidate codes and their rank fusion.

A retrieval result is a table ``query_id, hs_code, pos, ...`` whose ``pos``
(from 0) is the rank within the query; nothing depends on row order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolore.functions.scores import FEATURE_WEIGHTS, PairScorer, lexical_logit, sigmoid
from cargolore.functions.text import candidate_text
from cargolore.operators import fulltext, vectors
from cargolore.sources.scratch import stored

TOP_K = 50
RRF_K = 60
NUMERIC = ("dense_similarity", "dense_via_training", "sparse_score", "entity_overlap_score")
META = ("level", "chapter", "title", "description")
#: Sets of pairs of a tile, about: of codes and of queries.
TILE_CODES, TILE_QUERIES = 32_768, 4096


def rank(rows: DataFrame, by: Column | list[Column], k: int | None = None, key: str | list[str] = "query_id", name: str = "pos") -> DataFrame:
    """``rows`` with their place within ``key`` (from 0); only the first ``k`` if given."""
    order = by if isinstance(by, list) else [by]
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    ranked = ranked if k is None else ranked.where(F.col(name) <= k)
    return ranked.withColumn(name, (F.col(name) - 1).cast("long"))


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, among: tuple[str, str] | None = None) -> DataFrame:
    """For each of ``query_id, q`` the ``k`` nearest of ``hs_code, v`` by cosine,
    exact, in double precision; zero vectors and vectors of other lengths are never
    found, ties go to the lesser code.  ``among`` names a list column of each side:
    only rows that share a value with the query are looked at.  Both sides may be large,
    see :mod:`cargolore.operators.vectors`.
    """
    asked = queries.select("query_id", *(c for c in queries.columns if c != "query_id"))
    rows = corpus.select("hs_code", *(c for c in corpus.columns if c != "hs_code"))
    return rank(vectors.nearest(asked, rows, k, among), [F.desc(F.round("similarity", 12)), F.asc("hs_code")], k)


def sparse_topk(queries: DataFrame, index: DataFrame, k: int = TOP_K, key: str = "hs_code") -> DataFrame:
    """The ``k`` documents of an index of :func:`fulltext.indexed` that best cover
    all lexemes of a query, normalised by the query's best."""
    best = fulltext.best(queries, index, k, key)
    return best.withColumn("sparse_score", F.col("rank") / F.max("rank").over(Window.partitionBy("query_id")))


def sparse_with_training(queries: DataFrame, index: DataFrame, examples: DataFrame, k: int = TOP_K, factor: float = 0.9) -> DataFrame:
    """Codes by their words, joined by labelled examples of codes.

    ``index`` is of codes, ``examples`` is a table ``example_id, hs_code, text``.  The ``k``
    best of each are normalised by the query's best of both; an example counts ``factor``
    of its score for its code, which gets the larger of what it has of both."""
    own = fulltext.best(queries, index, k).select("query_id", "hs_code", F.col("rank").alias("c"), F.lit(0.0).alias("t"))
    labelled = examples.where("hs_code IS NOT NULL")
    found = fulltext.best(queries, fulltext.indexed(labelled, key="example_id"), k, "example_id")
    best = found.join(labelled.select("example_id", "hs_code"), "example_id")
    both = own.unionByName(best.select("query_id", "hs_code", F.lit(0.0).alias("c"), F.col("rank").alias("t")))
    both = both.withColumn("top", F.max(F.greatest("c", "t")).over(Window.partitionBy("query_id")))
    scored = both.groupBy("query_id", "hs_code").agg(F.max(F.greatest(F.col("c"), factor * F.col("t")) / F.col("top")).alias("sparse_score"))
    return rank(scored, [F.desc("sparse_score"), F.asc("hs_code")])


def _entity_tile(k: int):  # noqa: ANN202
    """Each query set's ``k`` best code sets of a tile by weight to nine places, then code.  The
    weights of a pair are added where its codes are; no row is made for a query and a code."""

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        asked, codes = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        codes = codes.take(pc.sort_indices(codes["hs_code"], null_placement="at_start"))
        lists = codes["pairs"].combine_chunks()
        coded, own = lists.flatten().dictionary_encode(), np.repeat(np.arange(len(codes)), lists.value_lengths().to_numpy())
        weight = codes["weights"].combine_chunks().flatten()
        known, weight = weight.is_valid().to_numpy(zero_copy_only=False), weight.fill_null(0.0).to_numpy(zero_copy_only=False)
        # a code's weights by pair, and the codes of each pair one after the other
        pair = coded.indices.to_numpy()
        order = np.lexsort((own, pair))
        own, pair = own[order], pair[order]
        new = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (own[1:] != own[:-1]))[: len(own)])
        own, pair, weight, known = own[new], pair[new], np.add.reduceat(weight[order], new) if len(new) else weight, np.add.reduceat(known[order].astype(np.int64), new) if len(new) else known
        first = np.searchsorted(pair, np.arange(len(coded.dictionary) + 1))
        plain = bool((weight > 0).all())  # then a sum says whether a code was met
        wanted = asked["pairs"].combine_chunks()
        ends = np.append(0, np.cumsum(wanted.value_lengths().to_numpy()))
        places = pc.index_in(wanted.flatten(), value_set=coded.dictionary).fill_null(-1).to_numpy()
        rows, cols, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in range(len(asked)):
            total = np.zeros(len(codes))
            met, weighed = (total, None) if plain else (np.zeros(len(codes)), np.zeros(len(codes)))
            for p in places[ends[i] : ends[i + 1]]:
                if p >= 0:
                    at = slice(first[p], first[p + 1])
                    total[own[at]] += weight[at]
                    if not plain:
                        met[own[at]] += 1
                        weighed[own[at]] += known[at]
            found = np.flatnonzero(met > 0)
            value = total[found] if plain else np.where(weighed[found] > 0, total[found], -np.inf)
            if len(found) > k:
                some = value >= np.partition(value, -k)[-k] - 2e-9
                found, value = found[some], value[some]
            best = np.argsort(-np.round(value, 9), kind="stable")[:k]
            rows.append(np.full(len(best), i))
            cols.append(found[best])
            values.append(value[best])
        row, col, value = (np.concatenate(x) for x in (rows, cols, values))
        return pa.table([asked["query_id"].take(pa.array(row)), codes["hs_code"].take(pa.array(col)), pa.array(value, mask=np.isneginf(value))], names=["query_id", "hs_code", "weight"])

    return run


def entity_topk(entities: DataFrame, index: DataFrame, k: int = TOP_K) -> DataFrame:
    """Codes by the summed weights of a query's (type, value) pairs.

    Queries with the same pairs have the same codes, and codes with the same weighted pairs
    the same score for any query.  So sets of pairs meet once, the ``k`` best sets of codes
    are kept by their score and least code, and their ``k`` least codes are ranked: a code
    of another set has ``k`` codes before it.  Sets are dealt to blocks, and a block of
    queries and one of codes are a tile, which gives its ``k`` best: sets that share a
    frequent pair are compared there and never shuffled.  Scores are compared to nine places."""
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = entities.where("entity_type IS NOT NULL AND entity_value IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("entity_type", "entity_value"))).alias("pairs"))
    asked = stored(pairs.groupBy("pairs").agg(F.min(F.struct("query_id")).alias("asked")), "entity-queries")
    weighted = F.array_sort(F.collect_list(F.struct("entity_type", "entity_value", "weight")))
    held = index.where("entity_type IS NOT NULL AND entity_value IS NOT NULL").groupBy("hs_code").agg(weighted.alias("held"))
    codes = rank(held, F.asc("hs_code"), k, key="held")
    codes = stored(codes.withColumn("least", F.first(F.struct("hs_code")).over(Window.partitionBy("held").orderBy("pos"))), "entity-codes")
    posted = codes.where("pos = 0")
    one, two = pairs.schema["query_id"].dataType, held.schema["hs_code"].dataType
    blocks = [rows.agg(F.greatest(F.ceil(F.count("*") / n), F.lit(1)).cast("int")).scalar() for rows, n in ((asked, TILE_QUERIES), (posted, TILE_CODES))]

    def dealt(rows: DataFrame, key: str, listed: str, asks: bool) -> DataFrame:
        own, other = F.pmod(F.xxhash64(key), blocks[not asks]).cast("int"), F.explode(F.sequence(F.lit(0), blocks[asks] - 1))
        named = F.transform(listed, lambda x: F.concat(F.length(x["entity_type"]).cast("string"), F.lit(":"), x["entity_type"].cast("string"), x["entity_value"].cast("string")))
        weights = F.lit(None).cast("array<double>") if asks else F.transform(listed, lambda x: x["weight"].cast("double"))
        ids = [F.col(f"{key}.{n}").alias(n) if n in rows.schema[key].dataType.names else F.lit(None).cast(t).alias(n) for n, t in (("query_id", one), ("hs_code", two))]
        met = rows.select(own.alias("own"), other.alias("other"), F.lit(asks).alias("asks"), *ids, named.alias("pairs"), weights.alias("weights"))
        return met.withColumnsRenamed({"own": "q" if asks else "c", "other": "c" if asks else "q"}).select("q", "c", "asks", "query_id", "hs_code", "pairs", "weights")

    # few bytes and much work: not to be put together in one task
    tiles = dealt(asked, "asked", "pairs", True).unionByName(dealt(posted, "least", "held", False)).repartition(tasks, "q", "c")
    found = tiles.groupBy("q", "c").applyInArrow(_entity_tile(k), T.StructType([T.StructField("query_id", one), T.StructField("hs_code", two), T.StructField("weight", T.DoubleType())]))
    met = found.select(F.struct("query_id").alias("asked"), F.struct("hs_code").alias("least"), "weight", F.round("weight", 9).alias("__by"))
    sets = rank(met, [F.desc("__by"), F.asc("least")], k, key="asked")
    best = sets.drop("pos").join(codes.select("least", "hs_code"), "least")
    best = rank(best, [F.desc("__by"), F.asc("hs_code")], k, key="asked")
    best = best.withColumn("entity_overlap_score", F.col("weight") / F.max("weight").over(Window.partitionBy("asked")))
    of_query = pairs.join(asked, "pairs").select("query_id", "asked")
    return of_query.join(best, "asked").select("query_id", "hs_code", "weight", "pos", "entity_overlap_score")


def with_training(codes: DataFrame, training: DataFrame, score: str, via: str | None, factor: float) -> DataFrame:
    """A code list joined by labelled examples of codes.

    ``codes`` and ``training`` have ``query_id, hs_code, score``.  Codes keep
    their score, an example's best score goes to ``via``; codes known from
    examples only get ``factor`` of it.  Codes come first, by score, then those.
    """
    best = training.groupBy("query_id", "hs_code").agg(F.max("score").alias("t"))
    both = codes.select("query_id", "hs_code", F.col("score").alias("c")).join(best, ["query_id", "hs_code"], "full")
    known = F.col("c").isNotNull()
    value = F.when(known, F.col("c")).otherwise(factor * F.col("t")) if via else F.greatest(F.coalesce("c", F.lit(0.0)), factor * F.coalesce("t", F.lit(0.0)))
    out = both.withColumn(score, value)
    if via:
        out = out.withColumn(via, F.coalesce("t", F.lit(0.0)))
    out = rank(out.withColumn("known", known), [F.desc("known"), F.desc(F.when(known, F.col("c")).otherwise(F.col("t"))), F.asc("hs_code")])
    return out.drop("c", "t", "known")


def union(branches: dict[str, DataFrame], mode: str = "rrf", k: int = RRF_K) -> DataFrame:
    """One row a query and code from several retrieval lists.

    Numbers are the largest of the branches', metadata the first branch's that
    has any, in the order given; ``rrf_score`` is the sum of 1/(k + pos + 1), or
    0 in ``max`` mode (U2), where ``retrieval_score`` is the largest number.
    """
    rows = None
    for i, (name, branch) in enumerate(branches.items()):
        have = set(branch.columns)
        own = branch.select(
            "query_id", "hs_code", F.lit(i).alias("branch"), F.lit(name).alias("source"), "pos",
            *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in NUMERIC),
            *(F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in META),
        )
        rows = own if rows is None else rows.unionByName(own)
    share = 1.0 / (k + F.col("pos") + 1) if mode == "rrf" else F.lit(0.0)
    first = [F.min_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("branch"))).alias(c) for c in META]
    out = rows.where("hs_code IS NOT NULL").groupBy("query_id", "hs_code").agg(*(F.max(c).alias(c) for c in NUMERIC), *first, F.sum(share).alias("rrf_score"))
    best = F.col("rrf_score") if mode == "rrf" else F.greatest(*NUMERIC)
    return out.withColumns({"retrieval_score": best, "level": F.col("level").cast("int"), "chapter": F.coalesce("chapter", F.substring("hs_code", 1, 2))})


def dynamic_head(rows: DataFrame, base: int = 20, cap: int = 50, gap: float = 0.001) -> DataFrame:
    """``rows`` with ``pos`` by retrieval score and ``in_head``: the first
    ``base``, and on while neighbours are less than ``gap`` apart, to ``cap``."""
    ranked = rank(rows, [F.desc("retrieval_score"), F.asc("hs_code")])
    own = Window.partitionBy("query_id").orderBy("pos")
    step = F.lag("retrieval_score").over(own) - F.col("retrieval_score")
    broken = ((F.col("pos") >= base) & ~(step < gap)).cast("int")
    ranked = ranked.withColumn("__broken", broken)
    return ranked.withColumn("in_head", (F.col("pos") < cap) & (F.max("__broken").over(own.rowsBetween(Window.unboundedPreceding, 0)) == 0)).drop("__broken")


def rerank(rows: DataFrame, queries: DataFrame, scorer: PairScorer = lexical_logit, base: int = 20, cap: int = 50) -> DataFrame:
    """The head of each query is scored with the pair scorer, the tail keeps
    its best dense similarity as a stand-in, marked ``ce_was_evaluated = 0``."""
    headed = dynamic_head(rows, base, cap).join(queries.select("query_id", F.col("text").alias("__q")), "query_id")
    pair = sigmoid(scorer(F.col("__q"), candidate_text(F.col("hs_code"), F.col("chapter"), F.col("title"), F.col("description"))))
    dense = F.greatest("dense_similarity", "dense_via_training")
    return headed.withColumns({
        "cross_encoder_score": F.when(F.col("in_head"), pair).otherwise(dense), "ce_was_evaluated": F.col("in_head").cast("double"),
    }).drop("__q")


def fuse(rows: DataFrame, weights: dict[str, float] = FEATURE_WEIGHTS, model: Column | None = None) -> DataFrame:
    """Features, final score rounded to 4 places, and final
    place: by score, ties by the place before."""
    own = Window.partitionBy("query_id")
    by_ce = own.orderBy(F.desc("cross_encoder_score"), "hs_code").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, second = F.nth_value("cross_encoder_score", 1).over(by_ce), F.nth_value("cross_encoder_score", 2).over(by_ce)
    in_chapter = F.count("chapter").over(Window.partitionBy("query_id", "chapter"))
    level = F.when(F.col("level").isin(2, 4, 6), F.col("level")).otherwise(F.least(F.length("hs_code"), F.lit(6)))
    out = rows.withColumns({
        "chapter_prior": F.coalesce(in_chapter / F.nullif(F.count("chapter").over(own), F.lit(0)), F.lit(0.0)),
        "candidate_depth": level.cast("double"),
        "top1_minus_top2_gap": F.greatest(F.lit(0.0), first - F.coalesce(second, F.lit(0.0))),
        "__dense": F.greatest("dense_similarity", "dense_via_training"),
    })
    linear = sum((F.lit(w) * F.col("__dense" if n == "dense_similarity" else n) for n, w in weights.items()), F.lit(0.0))
    out = out.withColumn("score", F.round(linear if model is None else model, 4))
    parts = F.struct(
        F.round("__dense", 4).alias("dense"), F.round("sparse_score", 4).alias("sparse"), F.round("entity_overlap_score", 4).alias("entity_overlap"),
        F.round("cross_encoder_score", 4).alias("cross_encoder"), F.round("chapter_prior", 4).alias("chapter_prior"), F.col("score").alias("ltr_final"),
    )
    return rank(out.withColumn("score_components", parts).drop("__dense"), [F.desc("score"), F.asc("pos")], name="place")


def confidence(ranked: DataFrame, k: int = 10, dense_floor: float = 0.4, ce_floor: float = 0.4) -> DataFrame:
    """One row a query from ``query_id, place, hs_code, chapter,
    score, score_components``: top score, gap, entropy, chapter shares."""
    top = ranked.where(F.col("place") < k).withColumn("mass", F.greatest("score", F.lit(0.0)))
    total = F.sum("mass").over(Window.partitionBy("query_id"))
    top = top.withColumn("p", F.when(total > 0, F.col("mass") / total).otherwise(0.0))
    first = F.col("place") == 0
    agree = (F.col("score_components.dense") > dense_floor) & (F.col("score_components.sparse") > 0) & (F.col("score_components.cross_encoder") > ce_floor)
    # one pass: a query's chapters are summed where its candidates are, then the chapters
    chapters = top.groupBy("query_id", "chapter").agg(
        F.sum("p").alias("share"), F.max(F.when(first, F.col("score"))).alias("one"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("two"),
        F.sum(F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") + 1e-12)).otherwise(0.0)).alias("spread"),
        F.bool_or(first & agree).alias("agree"), F.max(F.when(first, F.col("hs_code"))).alias("top_code"),
    )
    known = F.col("chapter").isNotNull()
    shares = F.collect_list(F.when(known, F.struct("chapter", F.round("share", 4).alias("share"))))
    out = chapters.groupBy("query_id").agg(
        F.round(F.max("one"), 4).alias("top1_score"),
        F.round(F.max("one") - F.coalesce(F.max("two"), F.lit(0.0)), 4).alias("top1_minus_top2"),
        F.round(-F.sum("spread"), 4).alias("entropy_topk"),
        F.coalesce(F.bool_or("agree"), F.lit(False)).alias("cross_source_agreement"),
        F.max("top_code").alias("top_code"),
        F.coalesce(F.round(F.max(F.when(known, F.col("share"))), 4), F.lit(0.0)).alias("chapter_consensus"),
        F.array_sort(shares).alias("__shares"),
    )
    # no map where no candidate has a chapter
    return out.withColumn("chapter_distribution", F.when(F.size("__shares") > 0, F.map_from_entries("__shares"))).drop("__shares")


def abstention(queries: DataFrame, confident: DataFrame, top1: float = 0.45, gap: float = 0.05, floor: float = 0.40) -> DataFrame:
    """``abstained, abstain_reason, fallback_level, fallback_code`` for
    every query, also those without candidates."""
    out = queries.select("query_id").join(confident, "query_id", "left")
    none, low = F.col("top1_score").isNull(), F.col("top1_score") < top1
    unclear = (F.col("top1_minus_top2") < gap) & (F.col("chapter_consensus") < floor)
    level = F.when(none, None).when(low, F.when(F.col("chapter_consensus") >= floor, 4).otherwise(2)).when(unclear, 2)
    return out.withColumns({
        "abstained": none | low | unclear,
        "abstain_reason": F.when(none, "no_candidates").when(low, "low_top1").when(unclear, "ambiguous_chapter"),
        "fallback_level": level,
        "fallback_code": fallback_code(F.col("top_code"), level),
    })


def fallback_code(code: Column, level: Column) -> Column:
    """The code cut to a level, or as far as it goes; null unless that is 2, 4 or 6."""
    n = F.least(level, F.length(code))
    return F.when(n.isin(2, 4, 6) & level.isin(2, 4, 6), F.substring(code, F.lit(1), n))


def classify(queries: DataFrame, codes: DataFrame, dense: DataFrame | None = None, entities: tuple[DataFrame, DataFrame] | None = None, scorer: PairScorer = lexical_logit, examples: DataFrame | None = None) -> DataFrame:
    """Candidates of each ``query_id, text``, retrieved, fused and reranked.

    ``codes`` has ``hs_code, level, chapter, title, description``; ``dense`` is a
    result of :func:`dense_topk`; ``entities`` pairs of queries and an index;
    ``examples`` labelled texts (``example_id, hs_code, text``).
    """
    index = fulltext.indexed(codes.withColumn("text", F.concat_ws(" ", "title", "description")))
    branches = {}
    if dense is not None:
        branches["dense"] = dense.withColumnRenamed("similarity", "dense_similarity")
    branches["sparse"] = sparse_topk(queries, index) if examples is None else sparse_with_training(queries, index, examples)
    if entities is not None:
        branches["entity"] = entity_topk(*entities)
    merged = union(branches).drop(*META).join(codes.select("hs_code", *META), "hs_code", "left")
    merged = merged.withColumn("chapter", F.coalesce("chapter", F.substring("hs_code", 1, 2)))
    return fuse(rerank(merged, queries, scorer))
