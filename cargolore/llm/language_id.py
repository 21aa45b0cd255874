"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: a naive Bayes model over hashed byte trigrams (A-Z lower-cased), fitted
  on at most ``TRAIN_ROWS`` labelled rows (drawn by id or place, so copies
  of a text are drawn each on its own) of at most ``LANGUAGES`` languages.  Trigrams of one text are not
  independent, so their mean log-likelihood counts as ``EVIDENCE`` trigrams at
  most.  An extra class, ``und``, gives every trigram the same probability.
* Declared language of the markup (``<html lang=...>``) and the address suffix
  (last label of the host, and a language label in the path): each is right
  with a stated reliability, and speaks for no language where it is missing.
* Host prior, smoothed by level: the expected languages of all other texts of a
  host are pulled towards those of its site (its last two labels), these towards
  those of all hosts.  The sums run over all rows in grouped aggregations; a
  row's own share is taken out of each, so no text counts twice.

The text evidence is computed once, written to the shared scratch folder, and read
for the sums and for the fusion.

Defined cases: null or empty texts, and texts without a letter, have the
language ``und`` and are rejected; a null host or address gives the prior of all
hosts; null ids are ids, repeated rows get equal results; with no labelled rows
all is ``und``.  An empty table gives no rows.  Columns other than those named
are passed on; a column with the name of an added one is replaced.  Names that
begin with two underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolore.llm.common import bound, byte_class, chunks, hot_join, materialize, text_buffer

#: Labelled rows that the text model is fitted on, at most.
TRAIN_ROWS = 20_000
#: Labels that the text model knows, the most frequent ones.
LANGUAGES = 256
TABLE = 1 << 16
EVIDENCE = 60.0
#: Posterior that the best language needs.
ACCEPT = 0.5
#: How much a host's prior is pulled to its site's, and a site's to all, in texts.
PULL = 20.0
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
#: Host priors up to so many rows are sent to all executors.
BROADCAST_HOSTS = 100_000
ADDED = ("language", "confidence", "text_language", "accepted")
# Address suffixes of countries by the language most used there.
COUNTRIES = {
    "ar": "ae bh dz eg iq jo kw lb ly ma om qa sa sd sy tn ye", "bg": "bg", "bn": "bd", "ca": "cat", "cs": "cz", "da": "dk", "de": "at de li", "el": "cy gr",
    "en": "au gh ie jm ng nz uk us", "es": "ar bo cl co cr cu do ec es gt hn mx ni pa pe py sv uy ve", "et": "ee", "eu": "eus", "fa": "ir", "fi": "fi", "fr": "bf ci fr ga mc ml sn",
    "gl": "gal", "he": "il", "hr": "hr", "hu": "hu", "id": "id", "is": "is", "it": "it sm va", "ja": "jp", "ka": "ge", "ko": "kr", "lt": "lt", "lv": "lv", "mn": "mn", "nl": "nl sr",
    "no": "no", "pl": "pl", "pt": "ao br mz pt", "ro": "md ro", "ru": "ru su", "sk": "sk", "sl": "si", "sq": "al", "sr": "rs", "sv": "se", "th": "th", "tr": "tr", "uk": "ua", "vi": "vn", "zh": "cn hk tw",
}
SUFFIXES = {suffix: lang for lang, known in COUNTRIES.items() for suffix in known.split()}


def trigram_places(data: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """For each byte, the table place of the trigram that it starts.  ``data`` may be
    several texts that end at ``ends``; each is followed by two bytes of padding."""
    read, _ = byte_class("folded")
    x = read[data].astype(np.uint32)
    second, third = np.append(x[1:], 32).astype(np.uint32), np.append(x[2:], [32, 32]).astype(np.uint32)[: len(x)]
    if len(x):
        ends = np.array([len(x)]) if ends is None else ends[ends > 0]
        second[ends - 1] = 32
        third[ends - 1] = 32
        third[np.maximum(ends - 2, 0)] = 32
    return ((x * np.uint32(0x9E3779B1)) ^ (second * np.uint32(0x85EBCA6B)) ^ (third * np.uint32(0xC2B2AE35))) >> np.uint32(16)


def training_rows(labelled: DataFrame, seed: int = 9, key: str | None = None) -> DataFrame:
    """At most ``TRAIN_ROWS`` rows of ``text, lang`` with a text and one of the
    ``LANGUAGES`` most frequent labels.

    ``key`` names a column of ids: rows are drawn by id and text; rows without an
    id, or all without a ``key``, are drawn by their place in the table."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    known = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    labelled, size = labelled.where(F.col("lang").isin([r["lang"] for r in known])), sum(r["count"] for r in known)
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    labelled = labelled.withColumn("__draw", F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(F.lit(seed), key, "text")), place) if key else place)
    rounds = 0
    while size > TRAIN_ROWS:
        share = int(1_000_003 * 0.98 * TRAIN_ROWS / size)
        labelled = labelled.where(F.pmod("__draw", F.lit(1_000_003)) < share)
        # drawn again by place if too many are left, as where rows repeat
        rounds += 1
        labelled = labelled.withColumn("__draw", F.xxhash64(F.lit(seed + rounds), F.monotonically_increasing_id()))
        size = labelled.count()
    return labelled.select("text", "lang")


def fit_text_model(labelled: DataFrame, seed: int = 9, key: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages (``und`` last) and log-probabilities, one row a language and one
    column a trigram place, from the :func:`training_rows` of ``labelled``."""
    labelled = training_rows(labelled, seed, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places = trigram_places(np.frombuffer(text.encode(), np.uint8))
                # a text counts as EVIDENCE trigrams at most ten times over
                weight = min(1.0, 10 * EVIDENCE / max(1, len(places)))
                np.add.at(sums.setdefault(lang, np.zeros(TABLE)), places, weight)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "place": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})

    counts = labelled.mapInArrow(run, "lang string, place int, n double").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most TABLE places for each of LANGUAGES languages
    langs = sorted(found["lang"].unique())
    logs = np.full((len(langs) + 1, TABLE), -np.log(TABLE))
    for i, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        n = np.full(TABLE, 0.05)
        n[own["place"].to_numpy()] += own["n"].to_numpy().round(6)
        logs[i] = np.log(n / n.sum())
    return [*langs, "und"], logs


def add_text_evidence(docs: DataFrame, langs: list[str], logs: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with ``__evidence``: a tempered log-likelihood
    for each language."""
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T.astype(np.float32)))
    schema = docs.limit(0).drop(text).withColumn("__evidence", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, ends = text_buffer(batch.column(text))
            out = np.zeros((batch.num_rows, table.shape[1]))
            for first, last in chunks(ends, 1_000_000):
                base = ends[first - 1] if first else 0
                part, stop = data[base : ends[last - 1]], ends[first:last] - base
                size = np.diff(stop, prepend=0)
                some = np.flatnonzero(size)
                if not len(some):
                    continue
                value = table[trigram_places(part, stop)]
                mean = np.add.reduceat(value, (stop - size)[some], axis=0, dtype=np.float64) / size[some][:, None]
                out[first + some] = mean * np.minimum(size[some], EVIDENCE)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], names=[*names, "__evidence"])

    return docs.mapInArrow(run, schema)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _softmax(logs: Column) -> Column:
    def shares(raw: Column) -> Column:
        return bound(_sum(raw), lambda total: F.transform(raw, lambda x: x / total))

    return bound(logs, lambda values: bound(F.array_max(values), lambda top: bound(F.transform(values, lambda x: F.exp(x - top)), shares)))


def _spoken(langs: list[str], said: Column, right: float) -> list[Column]:
    """Log-likelihoods of a statement that is right with the given probability."""
    n = len(langs) - 1
    known = said.isin(langs[:-1])
    return [F.when(~known | said.isNull(), F.lit(0.0)).when(said == lang, F.lit(float(np.log(right)))).otherwise(F.lit(float(np.log((1 - right) / max(1, n))))) for lang in langs]


def site_of(host: Column) -> Column:
    """The last two labels of a host, or the host."""
    return F.substring_index(F.lower(host), ".", -2)


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _pulled(counts: Column, to: Column) -> Column:
    """Shares of ``counts`` with ``PULL`` texts' worth of the shares ``to`` added."""
    return bound(counts, lambda own: bound(_sum(own) + PULL, lambda total: F.zip_with(own, to, lambda c, t: (c + PULL * t) / total)))


def identify(
    docs: DataFrame, labelled: DataFrame, *, text: str = "text", host: Column | None = None, declared: Column | None = None, suffix: Column | None = None,
    accept: float = ACCEPT, keep: tuple[str, ...] | None = None, key: str | None = None,
) -> DataFrame:
    """``docs`` with ``language``, ``confidence``, ``text_language``, ``accepted``.

    ``labelled`` has ``text, lang`` (and ``key``, see :func:`fit_text_model`).
    ``host``, ``declared`` and ``suffix`` are
    column expressions over ``docs``: a host or other origin, the language that
    the markup declares, and the language that the address speaks for.  ``keep``
    names the columns that are passed on, all by default.
    """
    none = F.lit(None).cast("string")
    langs, logs = fit_text_model(labelled, key=key)
    host, declared, suffix = (none if c is None else c for c in (host, declared, suffix))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    own = {"__host": host, "__site": site_of(host), "__declared": F.lower(F.regexp_extract(declared, "^[A-Za-z]*", 0)), "__suffix": suffix, "__letters": F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)), "__text": F.col(text)}
    base = docs.select(*kept, *(c.alias(n) for n, c in own.items()))
    scored = materialize(add_text_evidence(base, langs, logs, "__text"), "evidence")
    letters, n = F.col("__letters"), len(langs)

    # expected languages of the texts alone, by host, site and in all
    nothing = F.array(*(F.lit(0.0) for _ in langs))
    alone = F.when(letters, _softmax(F.col("__evidence"))).otherwise(nothing)
    shares = scored.select("__host", "__site", alone.alias("__own"))
    each = [F.round(F.sum(F.col("__own")[i]), 6).alias(f"n{i}") for i in range(n)]
    hosts = materialize(shares.groupBy("__host", "__site").agg(*each, F.count("*").alias("__rows")), "hosts")
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(n)]
    whole = hosts.agg(*sums).first()
    overall = F.array(*(F.lit(float(whole[f"n{i}"] or 0.0) + 1.0) for i in range(n)))
    listed = F.array(*(F.col(f"n{i}") for i in range(n)))
    sites = hosts.where("__site IS NOT NULL").groupBy("__site").agg(*sums).select("__site", listed.alias("__of_site"))
    prior = hosts.where("__host IS NOT NULL").select("__host", "__site", listed.alias("__of_host"), "__rows").join(sites, "__site").drop("__site")
    prior = materialize(prior, "host-priors")
    if prior.count() <= BROADCAST_HOSTS:
        fused = scored.join(F.broadcast(prior), "__host", "left")
    else:
        fused = hot_join(scored, prior, ["__host"], "__rows", F.xxhash64("__evidence"), "left")
    fused = fused.withColumn("__own", alone)
    in_all = bound(_minus(overall, F.col("__own")), lambda rest: bound(_sum(rest), lambda total: F.transform(rest, lambda x: x / total)))
    fused = fused.withColumn("__all", in_all)
    by_site = _pulled(_minus(F.col("__of_site"), F.col("__own")), F.col("__all"))
    by_host = _pulled(_minus(F.col("__of_host"), F.col("__own")), by_site)
    fused = fused.withColumn("__prior", F.when(F.col("__of_host").isNull(), F.col("__all")).otherwise(by_host))
    parts = zip(_spoken(langs, F.col("__declared"), DECLARED_RIGHT), _spoken(langs, F.col("__suffix"), SUFFIX_RIGHT), strict=True)
    said = F.array(*(a + b for a, b in parts))
    logs_of = F.zip_with(F.zip_with("__evidence", F.transform("__prior", lambda x: F.log(F.greatest(x, F.lit(1e-12)))), lambda a, b: a + b), said, lambda a, b: a + b)
    fused = fused.withColumn("__post", _softmax(logs_of))
    names = F.array(*(F.lit(x) for x in langs))

    def best(values: Column) -> Column:
        first = bound(values, lambda v: F.array_position(v, F.array_max(v)))
        return F.when(letters, names[(first - 1).cast("int")]).otherwise("und")

    out = fused.withColumns({
        "language": best(F.col("__post")),
        "confidence": F.when(letters, F.array_max("__post")).otherwise(F.lit(0.0)),
        "text_language": best(F.col("__evidence")),
    })
    return out.withColumn("accepted", (F.col("language") != "und") & (F.col("confidence") >= accept)).select(*kept, *ADDED)


def page_columns() -> dict[str, Column]:
    """Host, declared language and address language of ``url, html`` rows."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    last = F.substring_index(host, ".", -1)
    known = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    in_path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]{2})(?:[/?#-]|$)", 1)
    return {
        "host": F.nullif(host, F.lit("")),
        "declared": F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,8})", 1), F.lit("")),
        "suffix": F.coalesce(known[last], F.nullif(in_path, F.lit(""))),
    }


def visible_text(html: Column) -> Column:
    """Markup without scripts, styles, comments and tags."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(body, r"<[^>]*>", " ")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document; its source is its host, nothing is declared."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text", "source"), docs.select("doc_id", "text", "lang"), host=F.col("source"), keep=("doc_id",), key="doc_id")
    return found.select("doc_id", "language", "confidence", "text_language", "accepted")


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, with markup and address evidence; texts of documents train."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    body = pages.withColumn("body", visible_text(F.col("html")))
    found = identify(body, labelled, text="body", keep=("page_id",), key="doc_id", **page_columns())
    return found.select("page_id", "language", "confidence", "text_language", "accepted")
