"""Queries of metrics and calibration (§2.5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolore.functions.codes import grade
from cargolore.operators import evaluation as ev
from cargolore.operators import lambdamart
from cargolore.plans.tables import Tables
from cargolore.sources.scratch import stored


def _ranked(t: Tables) -> DataFrame:
    lists = t["ranked"].groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "hs_code"))), lambda x: x["hs_code"]).alias("predicted"))
    return t["gold"].join(lists, "query_id", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))


_RANKED = "WITH ra AS (SELECT g.query_id, gold, coalesce(list(hs_code ORDER BY place, hs_code) FILTER (hs_code IS NOT NULL), []) AS predicted FROM gold AS g LEFT JOIN ranked AS r ON r.query_id = g.query_id GROUP BY ALL)\n"
_CONFUSION = _RANKED + ", cm AS (SELECT substring(gold, 1, 2) AS gold_chapter, coalesce(substring(predicted[1], 1, 2), '??') AS predicted_chapter, count(*) AS n FROM ra GROUP BY ALL)\n"


def _detection(t: Tables) -> DataFrame:
    return ev.detection(t["record"].select(F.col("correct").alias("positive"), "score"), 0.6)


def _rule_rows(t: Tables) -> DataFrame:
    own = t["lineitem"].groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_suppkey"))).alias("expected"), F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_suppkey"))).alias("fired"))
    return ev.micro_precision_recall(own)


def _parity(t: Tables) -> DataFrame:
    a = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    b = F.transform(F.array_sort(F.collect_list(F.struct("l_extendedprice", "l_partkey"))), lambda x: x["l_partkey"])
    rows = t["lineitem"].groupBy("l_orderkey").agg(a.alias("a"), b.alias("b"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("relevant"))
    return ev.parity(rows, k=3, recall_k=4)


_PARITY = """WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a, list(l_partkey ORDER BY l_extendedprice, l_partkey) AS b, coalesce(list(DISTINCT l_partkey) FILTER (l_quantity > 25), []) AS rel FROM lineitem GROUP BY 1),
m AS (SELECT len(list_intersect(a[1:3], b[1:3]))::DOUBLE / len(list_distinct(list_concat(a[1:3], b[1:3]))) AS j, coalesce(len(list_intersect(list_distinct(b[1:4]), rel))::DOUBLE / nullif(len(rel), 0), 0) AS r,
  CASE WHEN len(rel) > 0 THEN list_sum(list_transform(range(1, len(b[1:3]) + 1), lambda i: CASE WHEN list_contains(rel, b[i]) THEN 1 / log2(i + 1) ELSE 0 END)) / list_sum(list_transform(range(1, least(3, len(rel)) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS n FROM l)
SELECT round(avg(j), 6) AS jaccard, round(avg(r), 6) AS recall, round(avg(n), 6) AS ndcg, count(*) AS n FROM m"""


def _grid(t: Tables) -> DataFrame:
    return t.spark.range(1, 20).select(F.round(F.col("id") / 20, 2).alias("threshold"))


_SWEEP = """WITH g AS (SELECT round(i / 20.0, 2)::DOUBLE AS threshold FROM range(1, 20) AS x(i)),
cu AS (SELECT threshold, coalesce(round(count(*) FILTER (score >= threshold AND correct) / nullif(count(*) FILTER (score >= threshold), 0)::DOUBLE, 6), 0) AS precision, coalesce(round(count(*) FILTER (score >= threshold) / count(*)::DOUBLE, 6), 0) AS coverage FROM g, record GROUP BY 1)
"""


def _grades(t: Tables) -> DataFrame:
    return t["ranked"].join(t["gold"], "query_id").select("query_id", "place", grade(F.col("hs_code"), F.col("gold")).alias("grade"))


def _ltr(t: Tables) -> DataFrame:
    """A ranker fitted on graded lines and its scores."""
    rows = _grades(t).join(t["ranked"], ["query_id", "place"]).withColumns({"f1": F.col("place").cast("double"), "f2": F.length("hs_code").cast("double"), "f3": F.substring("hs_code", 1, 2).cast("double")})
    model = ev.train_ranker(rows, ["f1", "f2", "f3"])
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(VectorAssembler(inputCols=["f1", "f2", "f3"], outputCol="features").transform(rows))
    return scored.select("query_id", "place", vector_to_array("probability")[1].alias("score"))


def _listwise(t: Tables) -> DataFrame:
    """A listwise ranker fitted on graded lines and its scores of them."""
    rows = stored(_grades(t).join(t["ranked"], ["query_id", "place"]), "graded-lines")  # read three times
    rows = rows.withColumns({"f1": F.col("place").cast("double"), "f2": F.length("hs_code").cast("double"), "f3": F.substring("hs_code", 1, 2).cast("double")})
    model = lambdamart.fit(rows, ["f1", "f2", "f3"])
    return rows.select("query_id", "place", "hs_code", model.column().alias("score"))


def _perturbed(t: Tables) -> DataFrame:
    gold = t["codes"].select("description", "hs_code")
    return ev.perturb(gold, F.array(*map(F.lit, _NOUNS)))


_NOUNS = ("steel", "copper", "brass", "plated")
_PERTURBED = f"""WITH b AS (SELECT description, hs_code, md5('42:' || description) AS o, substring(hs_code, 1, 2) AS c, string_split(description, ' ') AS w FROM codes),
n AS (SELECT *, list_filter(w, lambda x, i: x IN {_NOUNS} AND list_position(w, x) = i) AS nouns FROM b),
d AS (SELECT *, nouns[('0x' || substring(o, 1, 8))::BIGINT % len(nouns) + 1] AS noun FROM n WHERE len(nouns) > 0),
s AS (SELECT *, lead(hs_code) OVER (PARTITION BY c ORDER BY o, description, hs_code) AS other FROM b),
h AS (SELECT c, hs_code AS head FROM b QUALIFY row_number() OVER (PARTITION BY c ORDER BY o, description, hs_code) = 1),
x AS (SELECT c, coalesce(lead(head) OVER (ORDER BY c), first(head) OVER (ORDER BY c)) AS other FROM h)
SELECT description, hs_code, 'real' AS kind FROM b
UNION ALL SELECT array_to_string(list_filter(w, lambda x: x <> noun), ' '), hs_code, 'drop_noun' FROM d
UNION ALL SELECT description, other, 'in_chapter_swap' FROM s WHERE other <> hs_code
UNION ALL SELECT description, other, 'cross_chapter_swap' FROM b JOIN x USING (c) WHERE substring(other, 1, 2) <> c"""


def _sample(t: Tables) -> DataFrame:
    rows = t["codes"].select("p_partkey", F.substring("hs_code", 1, 2).alias("chapter"))
    return ev.seeded_sample(rows, "chapter", "p_partkey", 2, 100)


QUERIES = {
    "topk_accuracy": (
        lambda t: ev.topk_accuracy(_ranked(t)),
        _RANKED + "SELECT n AS level, k, round(avg(coalesce(len(list_filter(predicted[1:k], lambda c: substring(c, 1, n) = substring(gold, 1, n))) > 0, FALSE)::INT), 6) AS accuracy, count(*) AS n FROM ra, (VALUES (6), (4), (2)) AS x(n), (VALUES (1), (3)) AS y(k) GROUP BY 1, 2".replace("count(*) AS n FROM", "count(*) AS n FROM")),
    "mrr": (lambda t: ev.mean_reciprocal_rank(_ranked(t)), _RANKED + "SELECT round(avg(coalesce(1.0::DOUBLE / nullif(coalesce(list_position(predicted, gold), 0), 0), 0)), 6) AS mrr, count(*) AS n FROM ra"),
    "confusion": (lambda t: ev.confusion(_ranked(t)), _CONFUSION + "SELECT * FROM cm"),
    "hardest_pairs": (lambda t: ev.hardest_pairs(ev.confusion(_ranked(t))), _CONFUSION + "SELECT * FROM cm WHERE gold_chapter <> predicted_chapter ORDER BY n DESC, gold_chapter, predicted_chapter LIMIT 10"),
    "latency_percentiles": (
        lambda t: ev.latency(t["events"].select(F.col("value").alias("latency_ms"))),
        "SELECT round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(avg(value), 4) AS mean, count(value) AS n FROM events"),
    "sanctions_confusion": (
        _detection,
        "WITH c AS (SELECT count(*) FILTER (correct AND score >= 0.6) AS tp, count(*) FILTER (correct AND score < 0.6) AS fn, count(*) FILTER (NOT correct AND score >= 0.6) AS fp, count(*) FILTER (NOT correct AND score < 0.6) AS tn FROM record) SELECT *, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fp_rate FROM c"),
    "rule_precision_recall": (
        _rule_rows,
        """WITH l AS (SELECT l_orderkey, l_suppkey, bool_or(l_linenumber % 2 = 1) AS e, bool_or(l_quantity > 20) AS f FROM lineitem GROUP BY ALL), c AS (SELECT count(*) FILTER (e AND f) AS hits, count(*) FILTER (f) AS n_fired, count(*) FILTER (e) AS n_expected FROM l)
        SELECT *, round(hits / n_fired, 6) AS precision, round(hits / n_expected, 6) AS recall FROM c"""),
    "ranking_parity": (_parity, _PARITY),
    "threshold_sweep": (lambda t: ev.sweep(t["record"], _grid(t)), _SWEEP + "SELECT * FROM cu"),
    "threshold_best": (lambda t: ev.best_threshold(ev.sweep(t["record"], _grid(t)), 0.3), _SWEEP + "SELECT threshold, precision, coverage FROM cu ORDER BY coverage >= 0.3 DESC, precision DESC, coverage DESC, threshold LIMIT 1"),
    "brier_ece": (
        lambda t: ev.calibration_error(t["record"].withColumnRenamed("score", "prob")),
        """WITH b AS (SELECT score, correct::INT AS y, ntile(10) OVER (ORDER BY score, id) AS b FROM record), g AS (SELECT b, count(*) AS n, avg(score) AS p, avg(y) AS y, sum((score - y) ** 2) AS s FROM b GROUP BY 1)
        SELECT round(sum(s) / sum(n), 6) AS brier, round(sum(n * abs(p - y)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM g"""),
    "precision_cutoff": (
        lambda t: ev.precision_cutoff(t["record"], 0.5),
        "WITH s AS (SELECT score, count(*) AS n, count(*) FILTER (correct) AS c FROM record GROUP BY 1), w AS (SELECT score, sum(c) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS p FROM s) SELECT min(score) AS cutoff FROM w WHERE p >= 0.5"),
    "eval_gate": (
        lambda t: ev.gate(ev.latency(t["events"].select(F.col("value").alias("latency_ms"))), {"mean": 0.85}, {"p95": 1000.0}).select("metric", "bound", "passed"),
        "SELECT 'mean' AS metric, 0.85::DOUBLE AS bound, avg(value) >= 0.845 AS passed FROM events UNION ALL SELECT 'p95', 1000, quantile_cont(value, 0.95) <= 1050 FROM events"),
    "ltr_grades": (
        _grades,
        """SELECT r.query_id, place, CASE WHEN hs_code = gold THEN 4 WHEN substring(hs_code, 1, 4) = substring(gold, 1, 4) THEN 3 WHEN substring(hs_code, 1, 2) = substring(gold, 1, 2) THEN 2
        WHEN abs(substring(hs_code, 1, 2)::INT - substring(gold, 1, 2)::INT) = 1 THEN 1 ELSE 0 END AS grade FROM ranked AS r JOIN gold USING (query_id)"""),
    "stratified_split": (
        lambda t: ev.stratified_split(t["codes"].select("p_partkey", F.substring("hs_code", 1, 2).alias("chapter")), "chapter", "p_partkey").select("p_partkey", "split"),
        """WITH n AS (SELECT p_partkey, count(*) OVER (PARTITION BY substring(hs_code, 1, 2)) AS n, row_number() OVER (PARTITION BY substring(hs_code, 1, 2) ORDER BY md5('42:' || p_partkey), p_partkey) AS i FROM codes)
        SELECT p_partkey, CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM n"""),
    "seeded_sample": (
        _sample,
        """WITH n AS (SELECT p_partkey, substring(hs_code, 1, 2) AS chapter, md5('42:' || p_partkey) AS o, row_number() OVER (PARTITION BY substring(hs_code, 1, 2) ORDER BY md5('42:' || p_partkey), p_partkey) AS i FROM codes)
        SELECT p_partkey, chapter FROM n WHERE i <= 2 ORDER BY o, p_partkey LIMIT 100"""),
    "synthetic_perturbation": (_perturbed, _PERTURBED),
    "isotonic_fit": (lambda t: ev.isotonic(t["record"]), None),
    "ltr_gbt": (_ltr, None),
    "ndcg": (
        lambda t: lambdamart.ndcg_of(_grades(t)),
        """WITH g AS (SELECT r.query_id, place, CASE WHEN hs_code = gold THEN 4 WHEN substring(hs_code, 1, 4) = substring(gold, 1, 4) THEN 3 WHEN substring(hs_code, 1, 2) = substring(gold, 1, 2) THEN 2
          WHEN abs(substring(hs_code, 1, 2)::INT - substring(gold, 1, 2)::INT) = 1 THEN 1 ELSE 0 END AS grade FROM ranked AS r JOIN gold USING (query_id)),
        p AS (SELECT query_id, 2.0::DOUBLE ** grade - 1 AS gain, row_number() OVER (PARTITION BY query_id ORDER BY place, grade) AS i, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS b FROM g),
        d AS (SELECT query_id, k, coalesce(sum(gain / log2(i + 1)) FILTER (i <= k), 0) AS own, sum(gain / log2(b + 1)) FILTER (b <= k) AS best FROM p, (VALUES (1), (3), (5)) AS x(k) GROUP BY ALL)
        SELECT k, round(avg(own / best), 6) AS ndcg, count(*) AS n FROM d WHERE best > 0 GROUP BY k"""),
    "ltr_lambdamart": (_listwise, None),
}
