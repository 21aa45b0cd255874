"""Full-text search by positions: all lexemes of a query, ranked by cover density.

A document is its list of lexemes, where a lexeme's place is its position.  A query's
rarest lexeme finds the documents that may match, in one equi-join; each of these is
then met once, by its key, and must hold the other lexemes.  So a frequent lexeme is joined
only for queries that have no rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolore.functions.scores import bound
from cargolore.functions.stemming import lexemes

#: What a cover of no other words counts.
WEIGHT = 0.1


def cover_density(words: Column, terms: Column) -> Column:
    """the sum over the covers of ``terms`` in ``words`` of ``WEIGHT / (1 + other words)``.

    A cover is a run of words that holds all (distinct) terms and no shorter such run;
    its other words are those that are no term.  With one term each place of it is a
    cover.  One sweep over the terms' places keeps the last place of each term: a run
    that ends here begins at the least of these, and is a cover if no earlier run began
    there or later.
    """
    no_place = F.transform(terms, lambda _: F.lit(-1))
    start = F.struct(no_place.alias("last"), no_place.alias("nth"), F.lit(-1).alias("prev"), F.lit(0.0).alias("sum"))

    def step(a: Column, x: Column) -> Column:
        def put(values: Column, value: Column) -> Column:
            return F.transform(values, lambda v, j: F.when(j + 1 == x["t"], value).otherwise(v))

        def moved(v: Column) -> Column:
            first = F.array_min(v["last"])
            fresh = (first >= 0) & (first > a["prev"])
            others = (x["p"] - first) - (x["n"] - F.array_min(v["nth"]))
            return F.struct(
                v["last"].alias("last"), v["nth"].alias("nth"), F.when(fresh, first).otherwise(a["prev"]).alias("prev"),
                (a["sum"] + F.when(fresh, F.lit(1.0) / (1 + others)).otherwise(0.0)).alias("sum"),
            )

        return bound(F.struct(put(a["last"], x["p"]).alias("last"), put(a["nth"], x["n"]).alias("nth")), moved)

    placed = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("p"), F.array_position(terms, w).cast("int").alias("t"))), lambda x: x["t"] > 0)
    events = F.transform(placed, lambda x, i: F.struct(x["p"].alias("p"), x["t"].alias("t"), i.alias("n")))
    return bound(terms, lambda _: F.aggregate(events, start, step, lambda a: a["sum"] * WEIGHT))


def indexed(corpus: DataFrame, text: str = "text", key: str = "hs_code", config: str = "english") -> DataFrame:
    """``key, words`` of every document that has a key: its lexemes by position."""
    return corpus.where(F.col(key).isNotNull()).select(key, lexemes(F.col(text), config).alias("words"))


def matches(queries: DataFrame, index: DataFrame, key: str = "hs_code", config: str = "english") -> DataFrame:
    """``query_id, key, rank``: documents with every lexeme of a query
    (``query_id, text``, an id a row).  A query without lexemes finds nothing."""
    asked = queries.select("query_id", F.array_distinct(F.filter(lexemes(F.col("text"), config), lambda w: w != "")).alias("terms")).where("size(terms) > 0")
    posted = index.select(key, F.explode(F.array_distinct(F.filter("words", lambda w: w != ""))).alias("term"))
    known = posted.groupBy("term").agg(F.count("*").alias("df"))
    each = asked.select("query_id", "terms", F.explode("terms").alias("term")).join(known, "term", "left")
    rarest = each.groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"), F.first("terms").alias("terms"))
    rarest = rarest.where("r.df > 0").select("query_id", "terms", F.col("r.term").alias("term"))
    met = rarest.join(posted, "term").select("query_id", "terms", key).join(index, key)
    whole = met.where(F.forall("terms", lambda t: F.array_contains("words", t)))
    return whole.select("query_id", key, F.round(cover_density(F.col("words"), F.col("terms")), 9).alias("rank"))


def best(queries: DataFrame, index: DataFrame, k: int, key: str = "hs_code", config: str = "english") -> DataFrame:
    """The ``k`` best of :func:`matches` for each query, of equal rank the lesser key, with
    their ``pos``.  Equal documents cover a query alike, and queries with the same words ask
    the same.  So different texts meet different documents, the ``k`` best of which are kept by
    rank and least key, and the ``k`` least keys of each are ranked."""
    ranked = lambda rows, by, of: rows.withColumn("pos", F.row_number().over(Window.partitionBy(of).orderBy(*by))).where(F.col("pos") <= k)
    held = ranked(index.select(key, "words"), [F.asc(key)], "words")
    # a document is named by its least key
    held = held.withColumn("__least", F.min(key).over(Window.partitionBy("words"))).withColumnRenamed("pos", "__n")
    asked = queries.select("query_id", "text").groupBy("text").agg(F.min("query_id").alias("query_id"))
    found = matches(asked, held.where("__n = 1").select(F.col("__least"), "words"), "__least", config)
    top = ranked(found, [F.desc("rank"), F.asc("__least")], "query_id").drop("pos")
    rows = ranked(top.join(held.select("__least", key), "__least"), [F.desc("rank"), F.asc(key)], "query_id")
    of_text = rows.join(asked, "query_id").select("text", key, "rank", (F.col("pos") - 1).cast("long").alias("pos"))
    return queries.select("query_id", "text").join(of_text, "text").select("query_id", key, "rank", "pos")
