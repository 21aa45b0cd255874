"""Ranking metrics, calibration, and training data for ranking."""

from __future__ import annotations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolore.functions.codes import grade
from cargolore.operators.ranges import numbered, running
from cargolore.sources.scratch import stored

#: Ranges of scores whose blocks are pooled in one task.
POOL_FAN = 8


def topk_accuracy(ranked: DataFrame, ks: tuple[int, ...] = (1, 3), levels: tuple[int, ...] = (6, 4, 2)) -> DataFrame:
    """Of ``gold, predicted`` (codes by rank) the share with the gold's
    prefix among the first k: one row a level and k."""
    cells = [F.struct(F.lit(n).alias("level"), F.lit(k).alias("k"), _has_prefix(k, n).cast("int").alias("hit")) for n in levels for k in ks]
    return ranked.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.level", "c.k").agg(F.round(F.avg("c.hit"), 6).alias("accuracy"), F.count("*").alias("n"))


def _has_prefix(k: int, n: int) -> Column:
    return F.coalesce(F.exists(F.slice("predicted", 1, k), lambda c: F.substring(c, 1, n) == F.substring("gold", 1, n)), F.lit(False))


def mean_reciprocal_rank(ranked: DataFrame) -> DataFrame:
    """One row; a gold that was not ranked counts 0."""
    at = F.nullif(F.array_position("predicted", F.col("gold")), F.lit(0).cast("long"))
    return ranked.agg(F.round(F.avg(F.coalesce(1.0 / at, F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n"))


def confusion(ranked: DataFrame) -> DataFrame:
    """Gold and predicted chapters (``??`` without a prediction) and counts."""
    top = F.coalesce(F.substring(F.get("predicted", F.lit(0)), 1, 2), F.lit("??"))
    return ranked.groupBy(F.substring("gold", 1, 2).alias("gold_chapter"), top.alias("predicted_chapter")).agg(F.count("*").alias("n"))


def hardest_pairs(matrix: DataFrame, limit: int = 10) -> DataFrame:
    """The largest cells off the diagonal."""
    return matrix.where("gold_chapter <> predicted_chapter").orderBy(F.desc("n"), "gold_chapter", "predicted_chapter").limit(limit)


def latency(rows: DataFrame, column: str = "latency_ms") -> DataFrame:
    """Exact percentiles by linear interpolation, mean and count.  Values are
    counted and their counts added up by range, so no task holds them all."""
    shares = (0.5, 0.95, 0.99)
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("m"))
    upto = running(counted, [F.col("v")], {"upto": F.col("m")})
    whole = counted.agg(F.sum("m").alias("n"), F.sum(F.col("v") * F.col("m")).alias("total"))
    placed = upto.join(F.broadcast(whole), how="cross")  # one row

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("m") <= place) & (place < F.col("upto")), F.col("v")))

    cells = {}
    for q in shares:
        place = (F.col("n") - 1) * q
        cells[f"low{q}"], cells[f"high{q}"], cells[f"part{q}"] = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
    out = placed.agg(*(c.alias(n.replace(".", "_")) for n, c in cells.items()), F.max(F.col("total") / F.col("n")).alias("mean"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n"))
    low, high, part = ((lambda q, k=k: F.col(f"{k}{q}".replace(".", "_"))) for k in ("low", "high", "part"))
    return out.select(*(F.round(low(q) + (high(q) - low(q)) * part(q), 4).alias(f"p{round(q * 100)}") for q in shares), F.round("mean", 4).alias("mean"), "n")


def detection(rows: DataFrame, threshold: float) -> DataFrame:
    """Counts of ``positive`` (boolean) against ``score >= threshold``."""
    hit = F.coalesce(F.col("score") >= threshold, F.lit(False))
    out = rows.agg(
        F.count_if(F.col("positive") & hit).alias("tp"), F.count_if(F.col("positive") & ~hit).alias("fn"),
        F.count_if(~F.col("positive") & hit).alias("fp"), F.count_if(~F.col("positive") & ~hit).alias("tn"),
    )
    return out.withColumns({
        "recall": F.round(F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0)), 6),
        "fp_rate": F.round(F.coalesce(F.col("fp") / F.nullif(F.col("fp") + F.col("tn"), F.lit(0)), F.lit(0.0)), 6),
    })


def micro_precision_recall(rows: DataFrame) -> DataFrame:
    """Over arrays ``expected, fired`` taken as sets."""
    out = rows.agg(
        F.sum(F.size(F.array_intersect("expected", "fired"))).alias("hits"), F.sum(F.size(F.array_distinct("fired"))).alias("n_fired"),
        F.sum(F.size(F.array_distinct("expected"))).alias("n_expected"),
    )
    return out.withColumns({
        "precision": F.round(F.coalesce(F.col("hits") / F.nullif(F.col("n_fired"), F.lit(0)), F.lit(0.0)), 6),
        "recall": F.round(F.coalesce(F.col("hits") / F.nullif(F.col("n_expected"), F.lit(0)), F.lit(0.0)), 6),
    })


def parity(rows: DataFrame, k: int = 10, recall_k: int = 50) -> DataFrame:
    """How alike two rankings ``a, b`` (arrays of ids) are, and how well
    ``b`` finds ``relevant``: Jaccard at k, recall, NDCG at k (means)."""
    jaccard = F.size(F.array_intersect(F.slice("a", 1, k), F.slice("b", 1, k))) / F.nullif(F.size(F.array_union(F.slice("a", 1, k), F.slice("b", 1, k))), F.lit(0))
    recall = F.size(F.array_intersect(F.slice("b", 1, recall_k), F.col("relevant"))) / F.nullif(F.size(F.array_distinct("relevant")), F.lit(0))
    gains = F.transform(F.slice("b", 1, k), lambda x, i: F.when(F.array_contains("relevant", x), 1.0 / F.log2(i + 2)).otherwise(0.0))
    best = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.size("relevant")))), lambda i: 1.0 / F.log2(i + 1))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    ndcg = F.when(F.size("relevant") > 0, add(gains) / add(best)).otherwise(0.0)
    return rows.agg(*(F.round(F.avg(F.coalesce(v, F.lit(0.0))), 6).alias(n) for n, v in (("jaccard", jaccard), ("recall", recall), ("ndcg", ndcg))), F.count("*").alias("n"))


def sweep(records: DataFrame, grid: DataFrame) -> DataFrame:
    """Precision and coverage of ``score, correct`` at each ``threshold`` of
    ``grid``.  Records are first counted by the grid cell they fall in; the
    curve is a running sum over the grid, so records never meet all thresholds."""
    points = F.broadcast(grid.agg(F.array_sort(F.collect_set("threshold")).alias("g")))
    cell = F.size(F.filter("g", lambda t: t <= F.col("score")))
    counted = records.join(points, how="cross").groupBy(cell.alias("cell")).agg(F.count("*").alias("m"), F.count_if("correct").alias("c"))
    numbered = grid.select("threshold").distinct().withColumn("cell", F.row_number().over(Window.orderBy("threshold")))
    total = counted.agg(F.sum("m").alias("total"))
    below = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    curve = numbered.join(counted, "cell", "left").join(F.broadcast(total), how="cross")
    curve = curve.withColumns({"n": F.coalesce(F.sum("m").over(below), F.lit(0)), "hits": F.coalesce(F.sum("c").over(below), F.lit(0))})
    return curve.select(
        "threshold", F.round(F.coalesce(F.col("hits") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), 6).alias("precision"),
        F.round(F.coalesce(F.col("n") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 6).alias("coverage"),
    )


def best_threshold(curve: DataFrame, floor: float) -> DataFrame:
    """The most precise threshold with enough coverage (else of all), more
    coverage and then the lower threshold on ties."""
    order = F.struct((F.col("coverage") >= floor).cast("int"), "precision", "coverage", -F.col("threshold"))
    return curve.agg(F.max_by(F.struct("threshold", "precision", "coverage"), order).alias("b")).select("b.*")


def calibration_error(records: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and expected error over bins of equal numbers of ``id,
    prob, correct``.  Bins come from places by ``prob`` and ``id``, so neither all
    records nor those of a frequent ``prob`` are sorted by one task."""
    ranked = numbered(records, [F.col("prob"), F.col("id")], "__at").join(F.broadcast(records.agg(F.count("*").alias("__all"))), how="cross")  # one row
    # the first ``extra`` bins have one more record
    small, extra = F.floor(F.col("__all") / bins), F.col("__all") % bins
    wide = extra * (small + 1)
    bin_no = F.when(F.col("__at") < wide, F.floor(F.col("__at") / (small + 1))).otherwise(extra + F.floor((F.col("__at") - wide) / F.greatest(small, F.lit(1))))
    y = F.col("correct").cast("double")
    by_bin = ranked.groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n"), F.avg("prob").alias("p"), F.avg(y).alias("y"), F.sum((F.col("prob") - y) ** 2).alias("b"))
    return by_bin.agg(F.round(F.sum("b") / F.sum("n"), 6).alias("brier"), F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def isotonic(records: DataFrame) -> DataFrame:
    """``score, correct`` with an isotonic ``probability``: of all rising functions of
    the score the nearest to what was correct, by squares.

    Adjacent violators are pooled inside ranges of the score, and the ranges' blocks
    then ``POOL_FAN`` ranges at a time, up to one: blocks that were pooled can stand for
    their rows.  Of ``n`` records there are at most about ``n^(2/3)`` blocks, as their means are
    rising fractions of whole numbers.  A score finds its block by a running count of
    blocks, so nothing is gathered on the driver.  Records without a score or an
    answer take no part and have no probability.
    """
    known = records.where("score IS NOT NULL AND correct IS NOT NULL")
    by_score = known.groupBy(F.col("score").cast("double").alias("score")).agg(F.sum(F.col("correct").cast("long")).alias("y"), F.count("*").alias("n"))
    by_score = stored(by_score.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "isotonic-scores")
    kind = "part int, score double, y bigint, n bigint"
    blocks, parts = by_score.select("part", "score", "y", "n"), int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        blocks = blocks.groupBy("part").applyInArrow(_pooled, kind)
        if parts <= 1:
            break
        parts = -(-parts // POOL_FAN)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / POOL_FAN).cast("int"))
    blocks = stored(blocks, "isotonic-blocks")
    begins = blocks.select("score", F.lit(1).alias("first"))
    counted = running(by_score.select("score").join(begins, "score", "left"), [F.col("score")], {"block": F.coalesce("first", F.lit(0))})
    values = numbered(blocks, [F.col("score")], "at").select((F.col("at") + 1).alias("block"), (F.col("y") / F.col("n")).alias("probability"))
    found = counted.join(values, "block").select(F.col("score").alias("__score"), "probability")
    return records.join(found, F.when(F.col("correct").isNotNull(), F.col("score").cast("double")) == F.col("__score"), "left").drop("__score")


def _pooled(table: pa.Table) -> pa.Table:
    """Adjacent blocks (by first ``score``) pooled until their means rise."""
    table = table.sort_by("score")
    out: list[list] = []
    for score, y, n in zip(*(table[c].to_pylist() for c in ("score", "y", "n")), strict=True):
        out.append([score, y, n])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            _, y, n = out.pop()
            out[-1][1] += y
            out[-1][2] += n
    score, y, n = (list(c) for c in zip(*out, strict=True))
    return pa.table({"part": pa.array([table["part"][0].as_py()] * len(out), pa.int32()), "score": pa.array(score, pa.float64()), "y": pa.array(y, pa.int64()), "n": pa.array(n, pa.int64())})


def precision_cutoff(records: DataFrame, target: float) -> DataFrame:
    """The lowest score from which on the precision is at least ``target``."""
    by_score = records.where(F.col("score").isNotNull()).groupBy("score").agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))
    summed = running(by_score, [F.desc("score")], {"all_n": F.col("n"), "all_c": F.col("c")})
    return summed.where(F.col("all_c") / F.col("all_n") >= target).agg(F.min("score").alias("cutoff"))


def gate(metrics: DataFrame, floors: dict[str, float], ceilings: dict[str, float], tolerance: float = 0.005, slack: float = 50.0) -> DataFrame:
    """One row a metric (columns of the one row of ``metrics``): value, bound, passed."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(b)).alias("bound"), (F.col(m) >= b - tolerance).alias("passed")) for m, b in floors.items()]
    rows += [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(b)).alias("bound"), (F.col(m) <= b + slack).alias("passed")) for m, b in ceilings.items()]
    return metrics.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def stratified_split(rows: DataFrame, stratum: str, key: str, shares: tuple[float, float] = (0.70, 0.15), seed: int = 42) -> DataFrame:
    """``split`` train, validation or test: within each stratum by a
    seeded hash, with sizes rounded down and the rest for test."""
    own = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    placed = numbered(rows.withColumn("__o", own), [F.col(stratum), F.col("__o"), F.col(key)], "__at").persist(StorageLevel.DISK_ONLY)  # read twice
    starts = placed.groupBy(F.col(stratum).alias("__of")).agg(F.min("__at").alias("__start"), F.count("*").alias("__n"))
    placed = placed.join(starts, F.col(stratum).eqNullSafe(F.col("__of")))
    n, at = F.col("__n"), F.col("__at") - F.col("__start") + 1
    train = F.floor(n * shares[0])
    split = F.when(at <= train, "train").when(at <= train + F.floor(n * shares[1]), "validation").otherwise("test")
    return placed.withColumn("split", split).select(*rows.columns, "split")


def seeded_sample(rows: DataFrame, stratum: str, key: str, per: int, target: int, seed: int = 42) -> DataFrame:
    """At most ``per`` of each stratum, then at most ``target``, by a seeded hash."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    some = rows.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))).where(F.col("__n") <= per).drop("__n")
    return some.withColumn("__o", order).orderBy("__o", key).limit(target).drop("__o")


def perturb(rows: DataFrame, nouns: Column, seed: int = 42) -> DataFrame:
    """F23, T: ``description, hs_code`` as they are (``real``) and changed: a noun
    dropped, or the code exchanged with that of another row of the same chapter
    or of the next one in a seeded order.

    The next row comes from places over the whole table, so a chapter is no task."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("description")))
    chapter = F.substring("hs_code", 1, 2)
    base = rows.select("description", "hs_code", order.alias("__o"), chapter.alias("__c"), F.array_intersect(F.split("description", " "), nouns).alias("__nouns"))
    real = base.select("description", "hs_code", F.lit("real").alias("kind"))
    pick = F.element_at("__nouns", (F.conv(F.substring("__o", 1, 8), 16, 10).cast("long") % F.size("__nouns") + 1).cast("int"))
    dropped = base.where("size(__nouns) > 0").select(F.array_join(F.array_remove(F.split("description", " "), pick), " ").alias("description"), "hs_code", F.lit("drop_noun").alias("kind"))
    placed = numbered(base.where("__o IS NOT NULL AND __c IS NOT NULL"), [F.col(c) for c in ("__c", "__o", "description", "hs_code")], "__at")
    after = placed.select((F.col("__at") - 1).alias("__at"), F.col("__c"), F.col("hs_code").alias("__s"))
    swapped = placed.join(after, ["__at", "__c"]).where("__s <> hs_code").select("description", F.col("__s").alias("hs_code"), F.lit("in_chapter_swap").alias("kind"))
    heads = base.groupBy("__c").agg(F.min_by("hs_code", F.struct("__o", "description", "hs_code")).alias("__h"))
    heads = heads.withColumn("__n", F.coalesce(F.lead("__h").over(Window.orderBy("__c")), F.first("__h").over(Window.orderBy("__c")))).select("__c", "__n")
    crossed = base.join(F.broadcast(heads), "__c").where("substring(__n, 1, 2) <> __c").select("description", F.col("__n").alias("hs_code"), F.lit("cross_chapter_swap").alias("kind"))
    return real.unionByName(dropped).unionByName(swapped).unionByName(crossed)


def ranking_rows(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Candidates (``query_id, hs_code``, features) with their relevance."""
    return candidates.join(gold.select("query_id", F.col("gold")), "query_id").withColumn("grade", grade(F.col("hs_code"), F.col("gold")))


def train_ranker(rows: DataFrame, features: list[str], seed: int = 7):  # noqa: ANN201
    """Boosted trees on "grade is at least 3"; score with ``probability``.  Rows with equal
    features and label are one with their number as its weight; the rows are held in as many
    parts as a shuffle has, so a part stays small."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labelled = rows.withColumn("label", (F.col("grade") >= 3).cast("double"))
    different = labelled.groupBy(*features, "label").agg(F.count("*").cast("double").alias("weight"))
    table = VectorAssembler(inputCols=features, outputCol="features").transform(different.repartition(parts, *features, "label"))
    return GBTClassifier(maxIter=10, maxDepth=3, seed=seed, weightCol="weight").fit(table.select("features", "label", "weight"))
