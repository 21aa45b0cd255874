"""Screening shipments end to end: from texts and routes to nested results."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolore.functions.codes import level_label
from cargolore.functions.scores import PairScorer, lexical_logit
from cargolore.functions.text import decompose, normalize, normalize_party
from cargolore.operators import entities, retrieval, screening

ENGINE = "cargolore-1"
TOP_CANDIDATES, TOP_CODES, GATE = 10, 20, 0.5
#: Least likeness of a text and an alias.
ALIAS_MIN = 0.45


def version_stamp(runs: DataFrame | None = None, policy_version: str = "empty", **artifacts: str) -> Column:
    """Engine, artifacts, policy version and the last successful run of each
    source (``runs``: ``source, finished_at, status``; a row a source on the driver)."""
    latest = {} if runs is None else {r.source: r.at for r in runs.where("status = 'success'").groupBy("source").agg(F.date_format(F.max("finished_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("at")).collect()}
    values = {"engine": ENGINE, "policy": policy_version} | artifacts | {f"refdata.{s}": at for s, at in sorted(latest.items())}
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def split_goods(shipments: DataFrame, materials: Column) -> DataFrame:
    """One row a fragment of descriptions that surely name several goods:
    ``query_id`` is of the fragment, ``parent_id`` and ``fragment`` say whose."""
    split = shipments.withColumn("d", decompose(F.col("text"), materials)).where(F.col("d.confidence") >= GATE)
    each = split.select(F.col("query_id").alias("parent_id"), F.posexplode("d.fragments").alias("fragment", "f"))
    return each.select("parent_id", "fragment", F.concat_ws("#", F.col("parent_id").cast("string"), F.col("fragment").cast("string")).alias("query_id"), F.col("f.text").alias("text"))


def candidate_view(code: Column, level: Column, chapter: Column, title: Column, description: Column, score: Column, parts: Column) -> Column:
    """A candidate as results show it."""
    return F.struct(
        code.alias("hs_code"), level_label(level, code).alias("level"), F.coalesce(chapter, F.substring(code, 1, 2)).alias("chapter"), F.when(F.length(code) >= 4, F.substring(code, 1, 4)).alias("heading"),
        F.coalesce(F.nullif(title, F.lit("")), description, F.lit("")).alias("title"), score.alias("score"), parts.alias("score_components"),
    )


def sanction_matches(
    shipments: DataFrame, codes: DataFrame, goods: DataFrame, rules: DataFrame, aliases: DataFrame | None = None,
    embed: Callable[[Column], Column] = entities.embed, scorer: PairScorer = lexical_logit, embed_query: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``query_id, sanction_matches``, the best first, from the
    structured, dense, sparse and (if there are ``aliases``) alias paths.

    ``codes`` has ``query_id, codes`` of the shipments that have any; ``goods``
    are those in force.
    """
    routed = shipments.select("query_id", "text", "origin", "destination")
    structured = screening.structured(routed.drop("text").join(codes, "query_id"), goods, rules)
    paths = {
        "structured": structured,
        "dense": screening.dense_matches(routed.withColumn("q", (embed_query or embed)(F.col("text"))), goods, rules, embed=embed),
        "sparse": screening.sparse_matches(routed, goods, rules),
    }
    if aliases is not None:
        paths["alias"] = screening.alias_matches(routed.select("query_id", normalize_party(F.col("text")).alias("name")), aliases.join(goods.select("id"), "id", "left_semi"), ALIAS_MIN)
    own = F.col("restriction_type") if "restriction_type" in goods.columns else F.lit(None).cast("string")
    known = goods.select("id", "source", "source_record_id", "description", "hs_codes", own.alias("__restriction"))
    merged = screening.merge_matches(paths, known, routed, scorer=scorer).join(codes, "query_id", "left")
    merged = merged.join(structured.select("query_id", "id", "restriction_type", "n_rules"), ["query_id", "id"], "left")
    overlap = F.array_sort(F.coalesce(F.array_intersect("hs_codes", "codes"), F.array().cast("array<string>")))
    parts = F.struct(
        F.round("dense", 4).alias("dense"), F.round("sparse", 4).alias("sparse"), F.round("cross_encoder", 4).alias("cross_encoder"),
        F.round("alias", 4).alias("alias_trigram"), "structured_match", "rrf_score",
    )
    view = F.struct(
        "pos", "source", "source_record_id", "description", overlap.alias("hs_code_overlap"), F.coalesce("restriction_type", "__restriction").alias("restriction_type"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"),
        "similarity", parts.alias("score_components"),
    )
    return merged.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(view)), lambda x: x.dropFields("pos")).alias("sanction_matches"))


def screen(
    shipments: DataFrame, codes: DataFrame, goods: DataFrame, rules: DataFrame, screening_rules: DataFrame, gazetteer: DataFrame,
    *, on: dt.date, versions: Column, scorer: PairScorer = lexical_logit, aliases: DataFrame | None = None, embed: Callable[[Column], Column] = entities.embed,
    embed_query: Callable[[Column], Column] | None = None, dense: bool = False, examples: DataFrame | None = None,
) -> DataFrame:
    """One nested result for each of ``query_id, text, origin, destination, value,
    currency, metadata``.

    Candidates from words (also of labelled ``examples``, ``example_id, hs_code, text``), from
    entities and, with ``dense``, from vectors are fused, reranked and scored.  Controlled goods are found by the best codes, by vectors
    (``embed``; ``embed_query`` for the shipments' side) and by words, all on the shipment's route, and by ``aliases``
    (``id, alias``), and the four lists are merged.  Rules are scored; descriptions of several goods are also classified by
    fragment.  What follows from a text, or from a text and a route, is found once for each different one.  Rules and
    fragments are keyed by ``query_id``; every part is joined once at the end.
    Candidates and rule scores are persisted on disk while the result is made.
    """
    clean = shipments.withColumn("text", normalize(F.col("text")))
    # what follows from a text alone is found once for each different text, which is its id
    texts = clean.select(F.col("text").alias("query_id"), "text").distinct()
    spans = entities.dedupe_spans(entities.gazetteer_spans(texts, gazetteer)).persist(StorageLevel.DISK_ONLY)  # read four times
    index = entities.entity_index(codes, gazetteer).persist(StorageLevel.DISK_ONLY)  # read twice

    def classified(asked: DataFrame, found: DataFrame) -> DataFrame:
        pairs = found.select("query_id", F.col("label").alias("entity_type"), F.col("text").alias("entity_value"))
        near = None
        if dense:
            vectors = asked.select("query_id", (embed_query or embed)(F.col("text")).alias("q"))
            near = retrieval.dense_topk(vectors, codes.select("hs_code", embed(F.concat_ws(" ", "title", "description")).alias("v")))
        return retrieval.classify(asked.select("query_id", "text"), codes, dense=near, entities=(pairs, index), scorer=scorer, examples=examples)

    ranked = classified(texts, spans).persist(StorageLevel.DISK_ONLY)  # read three times
    confident = retrieval.confidence(ranked)
    held = retrieval.abstention(texts, confident)
    view = candidate_view(*(F.col(c) for c in ("hs_code", "level", "chapter", "title", "description", "score", "score_components")))
    top = ranked.where(F.col("place") < TOP_CANDIDATES).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", view.alias("c")))), lambda x: x["c"]).alias("top_candidates"))

    of_text = ranked.where(F.col("place") < TOP_CODES).groupBy(F.col("query_id").alias("text")).agg(F.collect_set("hs_code").alias("codes"))
    # shipments with one text and route have the same sanction matches; one of each stands for all
    route = ["text", "origin", "destination"]
    kinds = clean.groupBy(*route).agg(F.min("query_id").alias("query_id")).persist(StorageLevel.DISK_ONLY)  # read often
    own_codes = kinds.select("query_id", "text").join(of_text, "text").select("query_id", "codes")
    sanctions = sanction_matches(kinds, own_codes, screening.active_goods(goods, on), rules, aliases, embed, scorer, embed_query)

    fired = screening.score_rules(clean, screening_rules, scorer).persist(StorageLevel.DISK_ONLY)  # read twice
    rule_view = F.struct("pos", "rule_id", "phrase", "phrase_similarity", "threshold", "delta_above_threshold", "conditions_satisfied", "mode", "created_by")
    by_rule = fired.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(rule_view)), lambda x: x.dropFields("pos")).alias("rule_matches"))
    by_list = screening.group_by_list(fired).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("top_similarity")).alias("__o"), "list", "top_phrase", "top_similarity", "n_above_threshold", "n_total"))).alias("rule_matches_by_list"))

    # fragments are of the descriptions as they came
    materials = spans.where("label = 'material'").groupBy(F.col("query_id").alias("__text")).agg(F.collect_set("text").alias("materials"))
    named = shipments.withColumn("__text", normalize(F.col("text"))).join(materials, "__text")
    parts = split_goods(named, F.col("materials")).withColumn("clean", normalize(F.col("text"))).persist(StorageLevel.DISK_ONLY)  # read twice
    part_texts = parts.select(F.col("clean").alias("query_id"), F.col("clean").alias("text")).distinct()
    part_spans = entities.dedupe_spans(entities.gazetteer_spans(part_texts, gazetteer))
    part_best = classified(part_texts, part_spans).where("place = 0").select(F.col("query_id").alias("clean"), view.alias("c"))
    multi = parts.join(part_best, "clean").groupBy(F.col("parent_id").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("fragment", "text", "c"))), lambda x: x["c"]).alias("multi_commodity"))

    entity_map = spans.groupBy("query_id", "label").agg(F.array_sort(F.collect_list("text")).alias("v")).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "v"))).alias("extracted_entities"))
    told = texts.select("query_id")
    for part in (held, top, confident.select("query_id", "entropy_topk", "cross_source_agreement", "chapter_distribution"), entity_map):
        told = told.join(part.select(*(c for c in part.columns if c == "query_id" or c not in told.columns)), "query_id", "left")
    told = kinds.join(told.withColumnRenamed("query_id", "text"), "text", "left").join(sanctions, "query_id", "left").drop("query_id").withColumnsRenamed({c: f"__{c}" for c in route})
    out = clean.select("query_id", *route)
    for part in (by_rule, by_list, multi):
        out = out.join(part, "query_id", "left")
    # what shipments share is the most, and is joined last
    alike = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in route]
    out = out.join(told, alike[0] & alike[1] & alike[2], "left")
    metrics = F.struct("top1_score", "top1_minus_top2", "entropy_topk", "chapter_consensus", "cross_source_agreement")
    classification = F.struct(
        "top_candidates", "chapter_distribution", metrics.alias("confidence_metrics"), "abstained", "abstain_reason", "fallback_level", "fallback_code", "multi_commodity"
    )
    return out.select("query_id", F.lit(ENGINE).alias("engine_version"), classification.alias("hs_classification"), "sanction_matches", "rule_matches", "rule_matches_by_list", "extracted_entities", versions.alias("versions"))
