"""Matching shipments with controlled goods and with rules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolore.functions.predicates import effective, in_scope, satisfied
from cargolore.functions.scores import PairScorer, lexical_logit, sigmoid
from cargolore.functions.text import is_short_name, trigrams
from cargolore.operators import fulltext
from cargolore.operators.retrieval import RRF_K, dense_topk, rank
from cargolore.sources.scratch import stored

ALIAS_FLOOR = 0.3
#: Names and aliases of a tile, about, and names of it that are compared at a time.
TILE_TEXTS, STRIP_NAMES = 8192, 512
#: Trigrams that are shared by one pair in so many are columns of a product.
OFTEN_PAIRS = 1024
#: Good matches that each semantic path gives a query.
PATH_K = 50


def active_goods(goods: DataFrame, on: dt.date | Column, known_at: Column | None = None) -> DataFrame:
    """Versions of controlled goods in force on a day, current or as
    they were known at an instant."""
    on = on if isinstance(on, Column) else F.lit(on)
    known = F.col("sys_to").isNull() if known_at is None else (F.col("sys_from") <= known_at) & (F.col("sys_to").isNull() | (known_at < F.col("sys_to")))
    return goods.where(known & effective(F.col("valid_from"), F.col("valid_to"), on))


def structured(shipments: DataFrame, goods: DataFrame, rules: DataFrame) -> DataFrame:
    """Shipments whose codes a controlled good has and whose
    route one of the good's active rules covers.

    ``shipments``: ``query_id, origin, destination, codes``; ``goods``: ``id,
    hs_codes, ...``; ``rules``: ``id, rule_origin, rule_destination,
    restriction_type, active``.  Codes are exploded on both sides into an equi-
    join; the result has one row a shipment and good, with the shared codes and
    the number of rules (which in the ranking counts once).
    """
    left = shipments.select("query_id", "origin", "destination", F.explode(F.array_distinct("codes")).alias("code"))
    right = goods.select("id", F.explode(F.array_distinct("hs_codes")).alias("code"))
    shared = left.join(right, "code").groupBy("query_id", "origin", "destination", "id").agg(F.sort_array(F.collect_set("code")).alias("hs_code_overlap"))
    ruled = shared.join(rules.where("active"), "id").where(in_scope(F.col("origin"), F.col("destination"), F.col("rule_origin"), F.col("rule_destination")))
    return ruled.groupBy("query_id", "origin", "destination", "id").agg(
        F.first("hs_code_overlap").alias("hs_code_overlap"), F.min("restriction_type").alias("restriction_type"), F.count("*").alias("n_rules")
    )


def applicable(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Of ``query_id, origin, destination, id`` those with a rule for the route."""
    own = rules.where("active").select(F.col("id").alias("__id"), "rule_origin", "rule_destination")
    on = (F.col("id") == F.col("__id")) & in_scope(F.col("origin"), F.col("destination"), F.col("rule_origin"), F.col("rule_destination"))
    return pairs.join(own, on, "left_semi")


def route_keys(origin: Column, destination: Column) -> Column:
    """The routes of rules that cover a shipment's route, as text: its own, and those
    that are open at one end or both; an unknown end is covered by an open one only."""
    # concat is null where an end is unknown
    return F.array_compact(F.array(F.concat(origin, F.lit(">"), destination), F.concat(origin, F.lit(">*")), F.concat(F.lit("*>"), destination), F.lit("*>*")))


def dense_matches(shipments: DataFrame, goods: DataFrame, rules: DataFrame, k: int = PATH_K, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The ``k`` nearest goods (``id, v``) of shipments (``query_id, q, origin,
    destination``) among those whose rules cover the route.  A good carries its
    active rules' routes, so goods off the route take no place among the ``k``.
    With ``embed``, goods have a ``description`` instead of ``v``, and each different one
    is embedded once."""
    own = F.concat_ws(">", F.coalesce("rule_origin", F.lit("*")), F.coalesce("rule_destination", F.lit("*")))
    routes = rules.where("active").groupBy("id").agg(F.collect_set(own).alias("routes"))
    # a plan takes vectors for a few bytes each: without a hint they are sent through the driver
    routed = goods.select("id", "v" if embed is None else "description").join(routes.hint("merge"), "id")
    if embed is not None:
        # written, as filters on vectors would be pushed below the distinct
        made = stored(goods.select("description").distinct().select("description", embed(F.col("description")).alias("v")), "goods-vectors")
        routed = routed.join(made.hint("merge"), "description").drop("description")
    asked = shipments.select("query_id", "q", route_keys(F.col("origin"), F.col("destination")).alias("keys"))
    found = dense_topk(asked, routed.withColumnRenamed("id", "hs_code"), k, among=("keys", "routes"))
    return found.select("query_id", F.col("hs_code").alias("id"), "similarity")


def sparse_matches(shipments: DataFrame, goods: DataFrame, rules: DataFrame, k: int = PATH_K) -> DataFrame:
    """Goods whose description holds every word of a shipment's ``text`` (as it is,
    stop words too), the ``k`` that best cover them of those whose rules cover the route."""
    # each different text is searched for once, in each different description
    held = goods.where("id IS NOT NULL").select("id", "description")
    kinds = held.groupBy("description").agg(F.min("id").alias("__least"))
    index = fulltext.indexed(kinds, "description", "__least", "simple")
    found = fulltext.matches(shipments.select(F.col("text").alias("query_id"), "text").distinct(), index, "__least", "simple").withColumnRenamed("query_id", "text")
    found = found.join(kinds, "__least").join(held, "description").select("text", "id", "rank")
    routed = applicable(found.join(shipments.select("query_id", "text", "origin", "destination"), "text").drop("text"), rules)
    return rank(routed, [F.desc("rank"), F.asc("id")], k).select("query_id", "id", F.col("rank").alias("similarity"))


def _alias_tile(floor: float, names: list[str]):  # noqa: ANN202
    """Pairs of a tile's names and aliases that are alike, a strip of names at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asks = table["asks"].to_numpy()
        if asks.all() or not asks.any():
            return
        ids, own, sizes, rows, grams = [], [], [], [], []
        for name, side in zip(names, (asks, ~asks), strict=False):
            part = table.filter(pa.array(side))
            coded = part[name].combine_chunks().dictionary_encode(null_encoding="encode")
            order = np.argsort(coded.indices.to_numpy(), kind="stable")
            lists = part["grams"].combine_chunks().take(pa.array(order))
            ids.append(coded.dictionary)
            own.append(coded.indices.to_numpy()[order].astype(np.int64))
            sizes.append(lists.value_lengths().to_numpy().astype(np.float64))
            rows.append(np.repeat(np.arange(len(order)), sizes[-1].astype(np.int64)))
            grams.append(lists.flatten().to_numpy())
        shared = np.intersect1d(grams[0], grams[1])
        for s in (0, 1):
            at = np.searchsorted(shared, grams[s])
            held = np.append(shared, -1)[at] == grams[s]
            rows[s], grams[s] = rows[s][held], at[held]
        (n, m), count = (len(x) for x in sizes), [np.bincount(g, minlength=len(shared)) for g in grams]
        # trigrams of many pairs are columns of a product, pairs of the others are counted one by one
        often = count[0] * count[1] * OFTEN_PAIRS > n * m
        column = np.cumsum(often) - 1
        dense = [np.zeros((k, often.sum()), np.float32) for k in (n, m)]
        for s in (0, 1):
            held = often[grams[s]]
            dense[s][rows[s][held], column[grams[s][held]]] = 1
            rows[s], grams[s] = rows[s][~held], grams[s][~held]
        order = np.argsort(grams[1], kind="stable")
        holders, first = rows[1][order], np.searchsorted(grams[1][order], np.arange(len(shared) + 1))
        need = [x.astype(np.float32) * np.float32(floor / (1 + floor)) for x in sizes]
        several = any(len(i) < len(o) for i, o in zip(ids, own, strict=True))
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for low in range(0, n, STRIP_NAMES):
            high = min(low + STRIP_NAMES, n)
            both = dense[0][low:high] @ dense[1].T
            here = slice(*np.searchsorted(rows[0], (low, high)))
            start, many = first[grams[0][here]], first[grams[0][here] + 1] - first[grams[0][here]]
            alias = holders[np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())]
            np.add.at(both.reshape(-1), np.repeat(rows[0][here] - low, many) * m + alias, np.float32(1))
            i, j = np.nonzero(both >= (need[0][low:high, None] - np.float32(1e-2)) + need[1])
            like = both[i, j].astype(np.float64)
            with np.errstate(invalid="ignore"):  # texts without trigrams are like none
                like /= sizes[0][low + i] + sizes[1][j] - like
            sure = like >= floor
            found = [own[0][low + i[sure]], own[1][j[sure]], like[sure]]
            if several:
                # the last name's goods wait for its other names
                q, g, like = (np.concatenate(x) for x in zip(kept, found, strict=True))
                order = np.lexsort((g, q))
                q, g, like = q[order], g[order], like[order]
                new = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (g[1:] != g[:-1]))[: len(q)])
                found = [q[new], g[new], np.maximum.reduceat(like, new) if len(new) else like]
                cut = len(new) if high == n else np.searchsorted(found[0], own[0][high - 1])
                found, kept = [x[:cut] for x in found], [x[cut:] for x in found]
            yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(found[0])), ids[1].take(pa.array(found[1])), pa.array(found[2])], names=[*names, "similarity"])

    return run


def alias_matches(parties: DataFrame, aliases: DataFrame, floor: float = ALIAS_FLOOR) -> DataFrame:
    """Goods whose aliases are like a name, by trigrams.

    ``parties``: ``query_id, name``; ``aliases``: ``id, alias``.  Both sides are dealt to blocks
    by their id, and each pair of blocks is a tile: a task's group, whose shared trigrams are
    counted by matrix products.  A query and a good meet in one tile only, with all their names
    and aliases, so results are final there and are not shuffled.  Pairs of names and aliases
    are compared all, as at a low floor a share of all pairs is the result.
    Names too short to be told apart are left out.
    """
    if not 0 < floor <= 1:
        raise ValueError("floor is above 0 and at most 1")
    named = parties.where(~is_short_name(F.col("name"))).select("query_id", F.col("name").alias("text"))
    known = aliases.where("alias IS NOT NULL").select("id", F.col("alias").alias("text"))
    one, two = named.schema["query_id"].dataType, known.schema["id"].dataType
    tasks = int(parties.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = [rows.agg(F.greatest(F.ceil(F.count("*") / TILE_TEXTS), F.lit(1)).cast("int")).scalar() for rows in (named, known)]
    code = lambda g: F.ascii(g) * 65536 + F.ascii(F.substring(g, 2, 1)) * 256 + F.ascii(F.substring(g, 3, 1))

    def dealt(rows: DataFrame, key: str, asks: bool) -> DataFrame:
        # few bytes and much work: not to be put together in one task
        sets = rows.repartition(tasks, key).select(key, F.transform(trigrams(F.col("text")), code).alias("grams"))
        part, each = F.pmod(F.xxhash64(key), blocks[not asks]).cast("int"), F.explode(F.sequence(F.lit(0), blocks[asks] - 1))
        met = sets.select(key, "grams", part.alias("own"), each.alias("other"))
        ids = [F.col(key) if n == key else F.lit(None).cast(t).alias(n) for n, t in (("query_id", one), ("id", two))]
        return met.select((F.col("own") if asks else F.col("other")).alias("names"), (F.col("other") if asks else F.col("own")).alias("aliases"), F.lit(asks).alias("asks"), *ids, "grams")

    tiles = dealt(named, "query_id", True).unionByName(dealt(known, "id", False)).repartition(tasks, "names", "aliases")
    found = T.StructType([T.StructField("query_id", one), T.StructField("id", two), T.StructField("similarity", T.DoubleType())])
    return tiles.groupBy("names", "aliases").applyInArrow(_alias_tile(floor, ["query_id", "id"]), found)


def merge_matches(paths: dict[str, DataFrame], goods: DataFrame, queries: DataFrame | None = None, *, k: int = RRF_K, head: int = 10, mode: str = "rrf", scorer: PairScorer = lexical_logit) -> DataFrame:
    """One row a query and good from up to four paths.

    ``paths`` may have ``structured`` (``query_id, id``), ``dense``, ``sparse``
    (normalised by the query's best here) and ``alias`` (``query_id, id,
    similarity``).  A structured match adds a virtual first place and its own;
    the head by fused score is compared with ``queries`` (``query_id, text``).
    """
    rows = None
    for name, path in paths.items():
        value = F.col("similarity").cast("double") if "similarity" in path.columns else F.lit(1.0)
        own = path.select("query_id", "id", value.alias("v"), F.lit(name).alias("path"))
        rows = own if rows is None else rows.unionByName(own)
    # dealt once, for all sorts and sums of a query; these take much more memory than the bytes that are
    # shuffled, so partitions are not to be put together
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id")
    rows = rank(rows, [F.desc("v"), F.asc("id")], key=["query_id", "path"])
    own = {p: F.coalesce(F.max(F.when(F.col("path") == p, F.col("v"))), F.lit(0.0)) for p in ("dense", "sparse", "alias")}
    out = rows.groupBy("query_id", "id").agg(
        *(v.alias(p) for p, v in own.items()), F.bool_or(F.col("path") == "structured").alias("structured_match"), F.sum(1.0 / (k + F.col("pos") + 1)).alias("__rrf")
    )
    out = out.withColumn("sparse", F.coalesce(F.col("sparse") / F.nullif(F.max("sparse").over(Window.partitionBy("query_id")), F.lit(0.0)), F.lit(0.0)))
    virtual = F.when(F.col("structured_match"), 1.0 / (k + 1)).otherwise(0.0)
    fused = F.col("__rrf") + virtual if mode == "rrf" else F.greatest("dense", "sparse", "alias") + F.when(F.col("structured_match"), 0.3).otherwise(0.0)
    out = rank(out.withColumn("rrf_score", F.round(fused, 6)).drop("__rrf"), [F.desc("rrf_score"), F.asc("id")])
    ce = F.lit(0.0)
    if queries is not None:
        # before the join on goods, while rows lie by query
        out = out.join(queries.select("query_id", F.col("text").alias("__q")), "query_id", "left")
        ce = F.when(F.col("pos") < head, sigmoid(scorer(F.col("__q"), F.col("description")))).otherwise(0.0)
    out = out.join(goods, "id", "left")
    out = out.withColumn("cross_encoder", F.coalesce(ce, F.lit(0.0)))
    return out.withColumn("similarity", F.round(F.greatest("dense", "cross_encoder", "alias"), 4)).drop("__q")


def phrases_of(rules: DataFrame) -> DataFrame:
    """``mode`` and ``all_phrases`` of rules with ``phrase`` and
    ``phrase_group`` (struct ``mode, phrases``): an unknown mode is any_of, a
    group without phrases is the single phrase."""
    group = F.filter(F.col("phrase_group.phrases"), lambda p: F.coalesce(p != "", F.lit(False)))
    grouped = F.coalesce(F.size(group) > 0, F.lit(False))
    mode = F.when(F.col("phrase_group.mode").isin("any_of", "all_of"), F.col("phrase_group.mode")).otherwise("any_of")
    return rules.withColumns({"mode": F.when(grouped, mode).otherwise("single"), "all_phrases": F.when(grouped, group).otherwise(F.array("phrase"))})


def combine(values: Column, mode: Column) -> Column:
    """The least of all_of, else the greatest; 0 of none."""
    return F.coalesce(F.when(mode == "all_of", F.array_min(values)).otherwise(F.array_max(values)), F.lit(0.0))


def score_rules(shipments: DataFrame, rules: DataFrame, scorer: PairScorer = lexical_logit) -> DataFrame:
    """Active rules (or drafted ones) that cover a shipment's route, with the
    likeness of their phrases to its text, threshold margin, and conditions.

    ``shipments``: ``query_id, text, origin, destination, value, currency,
    metadata``.  Routes are matched by equi-joins, one for each of the four
    forms of a rule's route (either end open or not), so no shipment meets a
    rule whose route it does not have; a rule that is open at both ends meets
    all by definition.  Texts and phrases are prepared once each for a scorer that
    can; each different pair of them is scored once by a scorer of a model.
    ``pos`` orders a shipment's matches: the most like first, then by rule.
    """
    ready = phrases_of(rules.where("active"))
    prepare, compare = getattr(scorer, "prepare", None), getattr(scorer, "compare", None)
    if prepare:
        shipments = shipments.withColumn("__text", prepare(F.col("text")))
        ready = ready.withColumn("__phrases", F.transform("all_phrases", prepare))
    out = None
    for origin_open in (True, False):
        for destination_open in (True, False):
            own = ready.where((F.col("rule_origin").isNull() == origin_open) & (F.col("rule_destination").isNull() == destination_open))
            on = [shipments[a] == own[b] for a, b, is_open in (("origin", "rule_origin", origin_open), ("destination", "rule_destination", destination_open)) if not is_open]
            met = shipments.join(own, on) if on else shipments.join(own, how="cross")
            out = met if out is None else out.unionByName(met)
    likeness = lambda logit: F.round(sigmoid(logit), 6)
    if prepare:
        each = F.transform("__phrases", lambda p: likeness(compare(F.col("__text"), p)))
        out = out.withColumn("per_phrase", each).drop("__text", "__phrases")
    elif getattr(scorer, "vectorised", False):
        pairs = out.select("text", F.explode("all_phrases").alias("__p")).distinct()
        scored = pairs.select(F.col("text").alias("__t"), "__p", likeness(scorer(F.col("text"), F.col("__p"))).alias("__s"))
        by_text = out.select("text", "all_phrases").distinct().select("text", "all_phrases", F.explode("all_phrases").alias("__q"))
        by_text = by_text.join(scored, F.col("text").eqNullSafe(F.col("__t")) & (F.col("__q") == F.col("__p")))
        lists = by_text.groupBy(F.col("text").alias("__t"), F.col("all_phrases").alias("__a")).agg(F.map_from_entries(F.collect_set(F.struct("__p", "__s"))).alias("__m"))
        out = out.join(lists, F.col("text").eqNullSafe(F.col("__t")) & (F.col("all_phrases") == F.col("__a")))
        out = out.withColumn("per_phrase", F.transform("all_phrases", lambda p: F.element_at("__m", p))).drop("__t", "__a", "__m")
    else:
        out = out.withColumn("per_phrase", F.transform("all_phrases", lambda p: likeness(scorer(F.col("text"), p))))
    out = out.withColumn("phrase_similarity", F.round(combine(F.col("per_phrase"), F.col("mode")), 4))
    ok = satisfied(F.col("conditions"), F.col("value"), F.col("currency"), F.col("metadata"))
    out = rank(out, [F.desc("phrase_similarity"), F.asc("rule_id")])
    return out.withColumns({
        "delta_above_threshold": F.round(F.col("phrase_similarity") - F.col("threshold"), 4),
        "conditions_satisfied": F.when(F.col("conditions").isNull(), F.lit(True)).otherwise(ok),
    })


def group_by_list(matches: DataFrame, prefix: str = "sanctions_source:KW:") -> DataFrame:
    """Rule matches by keyword list: the best phrase (the first by rule id
    on ties), how many there are and how many reach their threshold."""
    own = matches.where(F.coalesce(F.startswith(F.col("created_by"), F.lit(prefix)), F.lit(False)))
    above = F.col("conditions_satisfied") & (F.col("phrase_similarity") >= F.col("threshold"))
    best = F.struct(F.col("phrase_similarity").alias("a"), (-F.col("rule_id")).alias("b"))
    return own.groupBy("query_id", F.substring("created_by", len(prefix) + 1, 1000).alias("list")).agg(
        F.max_by("phrase", best).alias("top_phrase"), F.max("phrase_similarity").alias("top_similarity"),
        F.count_if(above).alias("n_above_threshold"), F.count("*").alias("n_total"),
    )
