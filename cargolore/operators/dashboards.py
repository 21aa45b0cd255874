"""Queries over screening results, reference data and runs.

A result row has ``result_id, query_id, created_at, origin, destination,
top_candidates`` (array of ``hs_code, chapter, score``), ``sanction_matches``
(array of ``source, similarity``), ``rule_matches`` (array of ``rule_id, delta``)
and ``abstained``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolore.functions.predicates import severity, staleness

SORTS = ("recent", "risk_desc", "confidence_asc")
MAX_LIMIT, MAX_OFFSET = 500, 100_000


def top(field: str) -> Column:
    """A field of the best candidate."""
    return F.get("top_candidates", F.lit(0))[field]


def strongest(column: str, field: str) -> Column:
    """The largest value of a field over an array of structs; 0 if empty."""
    return F.coalesce(F.array_max(F.transform(F.col(column), lambda x: x[field])), F.lit(0.0))


def risk() -> Column:
    """T4: best sanction likeness, half the best rule margin, 0.3 if abstained."""
    return strongest("sanction_matches", "similarity") + 0.5 * strongest("rule_matches", "delta") + F.when(F.coalesce("abstained", F.lit(False)), 0.3).otherwise(0.0)


def filter_results(
    results: DataFrame, *, origin: str | None = None, destination: str | None = None, since=None, abstained: bool | None = None,  # noqa: ANN001
    has_sanctions: bool | None = None, has_rules: bool | None = None, chapter: str | None = None, min_score: float | None = None,
) -> DataFrame:
    """Each filter that is given."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    tests = {
        "origin": (origin, lambda v: F.col("origin") == v), "destination": (destination, lambda v: F.col("destination") == v),
        "since": (since, lambda v: F.col("created_at") >= F.lit(v)), "abstained": (abstained, lambda v: F.coalesce("abstained", F.lit(False)) == v),
        "sanctions": (has_sanctions, lambda v: (size("sanction_matches") > 0) == v), "rules": (has_rules, lambda v: (size("rule_matches") > 0) == v),
        "chapter": (chapter, lambda v: top("chapter") == v), "score": (min_score, lambda v: top("score") >= v),
    }
    for value, test in tests.values():
        if value is not None:
            results = results.where(test(value))
    return results


def result_rows(results: DataFrame) -> DataFrame:
    """The list view of results."""
    return results.select(
        "result_id", "origin", "destination", "created_at", F.coalesce("abstained", F.lit(False)).alias("abstained"), top("hs_code").alias("top_code"), top("score").alias("top_score"),
        F.coalesce(F.size("sanction_matches"), F.lit(0)).alias("sanctions_count"), strongest("sanction_matches", "similarity").alias("max_sanction_similarity"),
        F.coalesce(F.size("rule_matches"), F.lit(0)).alias("rules_count"), strongest("rule_matches", "delta").alias("max_rule_delta"), F.round(risk(), 6).alias("risk"),
    )


def page(results: DataFrame, sort: str = "recent", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of :func:`result_rows`, newest first on ties, then by id."""
    if sort not in SORTS or not 0 <= limit <= MAX_LIMIT or not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"sort={sort}, limit={limit}, offset={offset}")
    first = {"recent": [], "risk_desc": [F.desc("risk")], "confidence_asc": [F.asc(F.coalesce("top_score", F.lit(0.0)))]}[sort]
    return result_rows(results).orderBy(*first, F.desc("created_at"), F.asc("result_id")).offset(offset).limit(limit)


def with_shipments(results: DataFrame, shipments: DataFrame) -> DataFrame:
    """Results with the columns of their shipments that they do not have."""
    own = [c for c in shipments.columns if c == "query_id" or c not in results.columns]
    return results.join(shipments.select(*own), "query_id")


def count_results(results: DataFrame) -> DataFrame:
    """One row: how many results a page is taken from."""
    return results.agg(F.count("*").alias("n"))


def chapter_volume(results: DataFrame) -> DataFrame:
    """A1."""
    return results.groupBy(F.coalesce(top("chapter"), F.lit("?")).alias("chapter")).agg(F.count("*").alias("n"))


def hits_by_source(results: DataFrame) -> DataFrame:
    """A2."""
    return results.select(F.explode("sanction_matches").alias("m")).groupBy(F.coalesce("m.source", F.lit("?")).alias("source")).agg(F.count("*").alias("n"))


def route_counts(rows: DataFrame, missing: str = "?") -> DataFrame:
    """A3 (results, ``?``) and A6 (rules, ``*``): rows by origin and destination."""
    return rows.groupBy(F.coalesce("origin", F.lit(missing)).alias("origin"), F.coalesce("destination", F.lit(missing)).alias("destination")).agg(F.count("*").alias("n"))


def score_histogram(results: DataFrame, buckets: int = 10) -> DataFrame:
    """A4: best scores in equal buckets of [0, 1): 1.0 is in the next bucket, below 0 in bucket 0."""
    return results.where(top("score").isNotNull()).groupBy(F.expr(f"width_bucket(top_candidates[0].score, 0, 1, {buckets})").cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def override_rate(results: DataFrame, feedback: DataFrame) -> DataFrame:
    """By day, joined rows, overridden ones, and their share, and the same over distinct results."""
    both = results.select("result_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")).join(feedback.select("result_id", "kind"), "result_id", "left")
    over = F.coalesce(F.col("kind") == "override", F.lit(False))
    return both.groupBy("day").agg(
        F.count("*").alias("total"), F.count_if(over).alias("overridden"), F.round(F.count_if(over) / F.count("*"), 6).alias("rate"),
        F.count_distinct("result_id").alias("results"), F.count_distinct(F.when(over, F.col("result_id"))).alias("results_overridden"),
    )


def count_by(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows by some columns."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def list_counts(lists: DataFrame, goods: DataFrame, rules: DataFrame) -> DataFrame:
    """Keyword lists with their current goods and active rules."""
    g = goods.where("sys_to IS NULL").groupBy("source").agg(F.count("*").alias("n_goods"))
    r = rules.where("active").groupBy(F.substring_index("created_by", "sanctions_source:", -1).alias("of")).agg(F.count("*").alias("n_rules"))
    source = F.concat(F.lit("KW:"), F.col("name"))
    out = lists.join(g, source == g["source"], "left").join(r, source == r["of"], "left")
    return out.select("name", F.coalesce("n_goods", F.lit(0)).alias("n_goods"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"))


def latest_runs(runs: DataFrame, only_successful: bool = False) -> DataFrame:
    """The last run of each source; of equal starts the larger id."""
    own = runs.where("status = 'success'") if only_successful else runs
    first = Window.partitionBy("source").orderBy(F.desc("started_at"), F.desc("run_id"))
    return own.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def freshness(runs: DataFrame, now) -> DataFrame:  # noqa: ANN001
    """Age and colour of each source's last successful run."""
    days = staleness(F.col("finished_at"), now)
    return latest_runs(runs, True).select("source", "kind", days.alias("days"), severity(days, F.col("kind")).alias("severity"))


def worst(fresh: DataFrame) -> DataFrame:
    """The worst colour of all, red over gray over amber over green."""
    order = F.array_position(F.array(*(F.lit(c) for c in ("green", "amber", "gray", "red"))), F.col("severity"))
    return fresh.agg(F.max_by("severity", order).alias("worst"))


def search_titles(codes: DataFrame, text: str, level: int | None = None) -> DataFrame:
    """P7, P11."""
    out = codes.where(F.col("title").ilike(f"%{text}%"))
    return out if level is None else out.where(F.col("level") == level)


def children(codes: DataFrame) -> DataFrame:
    """Codes with those directly below them."""
    own = codes.select(F.col("parent_code").alias("hs_code"), F.col("hs_code").alias("child"))
    return codes.select("hs_code").join(own, "hs_code")


def rule_history(rules: DataFrame) -> DataFrame:
    """Versions of each rule, the newest first."""
    own = Window.partitionBy("name").orderBy(F.desc("version"))
    return rules.withColumns({"age": F.row_number().over(own).cast("long"), "is_latest": F.row_number().over(own) == 1})


def batch_progress(rows: DataFrame) -> DataFrame:
    """State of each batch from its rows' ``status``: done when none is
    pending, failed if then none has completed."""
    out = rows.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    over = F.col("completed") + F.col("failed") >= F.col("total")
    return out.withColumn("state", F.when(~over, "running").when(F.col("completed") == 0, "failed").otherwise("done"))


def run_plan(sources: DataFrame) -> DataFrame:
    """For ``source, has_files, needs`` (array) and ``n_rows``: ``run``, or why
    it is skipped: ``no_files``, ``dependency_empty``."""
    have = sources.agg(F.map_from_entries(F.collect_list(F.struct("source", "n_rows"))).alias("__n"))  # a row a source
    ok = F.forall("needs", lambda s: F.coalesce(F.col("__n")[s], F.lit(0)) > 0)
    return sources.join(F.broadcast(have), how="cross").select("source", F.when(~F.col("has_files"), "no_files").when(~ok, "dependency_empty").otherwise("run").alias("action"))
