"""Toxicity scores: boosted trees over dense features, isotonic calibration.

Labels are learned from at most ``TRAIN_ROWS`` labelled documents, those first
by a seeded hash among the rows that may be learned from.  They are cut in
three parts; of near copies with one label one is learned from, and near copies are in
one part.  A lexicon holds words, and first letters of words, that mark the
label, with their log-odds; a part's features come from the lexicon of the other
two parts, so they are as on rows that the lexicon has not seen.  Two parts fit
the trees, one the calibration.  Scoring covers every whole text with the lexicon
of all parts.

Features: densities and counts of the fixed and of the learned lexicon and of
its most frequent word beginning, the nearest second-person pronoun to a lexicon word, shares of capitals, of
punctuation and of exclamation marks, and rates of obfuscated words (letters
replaced by digits or signs, or stretched), found by undoing the replacement.

Defined cases: null and empty texts have all features zero and get the score
of such a document; a row without id is scored and counts as not held out;
repeated rows get equal scores; kept columns may have any names but ``score``; if no labelled rows of both kinds exist, every
score is the mean label, or 0.  Language, source and id are never features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolore.llm.common import materialize

#: Labelled documents that are learned from, at most.
TRAIN_ROWS = 24_000
#: Words and word beginnings in the learned lexicon, at most.
LEXICON_ROWS = 1_000
#: Labelled documents that a lexicon entry needs, and its log-odds in standard errors.
LEXICON_DOCS, LEXICON_Z = 4, 3.3
THRESHOLD = 0.7

# A small general lexicon and second-person pronouns.
INSULTS = ("trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron", "dumb", "fool", "jerk", "garbage", "ugly", "hate", "shut", "kill", "disgrace", "vermin")
SECOND_PERSON = ("you", "your", "yours", "yourself", "ur", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "usted", "ustedes", "tus", "contigo")
# Signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"}

FEATURES = (
    "fixed_hits", "fixed_share", "word_hits", "word_share", "word_weight", "word_best",
    "start_hits", "start_share", "start_weight", "start_best", "top_start_hits", "top_start_share",
    "near_second", "second_share", "capitals", "shouted", "punctuation", "exclaims", "obfuscated", "obfuscated_hits", "length",
)

_WORD = re.compile(r"[^\W_]+(?:[@$!+0-9]+[^\W_]*)*")
_STRETCH = re.compile(r"(\w)\1{2,}")
_LEET = str.maketrans(LEET)
#: Parts of the labelled rows; the last one calibrates.
PARTS = 3
#: Lengths of word beginnings; of several in the lexicon the longest counts.
_STARTS = (7, 6, 5, 4)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def plain(word: str) -> str:
    """A word with sign-for-letter replacements and stretched letters undone."""
    return _STRETCH.sub(r"\1", word.translate(_LEET))


def start_of(word: str, odds: dict) -> str | None:
    """The longest beginning of a word that the lexicon has."""
    for k in _STARTS:
        if len(word) > k and word[:k] in odds:
            return word[:k]
    return None


def features(text: str | None, fixed: frozenset, second: frozenset, word_odds: dict, start_odds: dict) -> list[float]:
    """The values of ``FEATURES`` for one whole text."""
    text = text or ""
    words = words_of(text)
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    odd = [plain(w) if not w.isalpha() and not w.isdigit() else w for w in words]
    changed = [i for i, (a, b) in enumerate(zip(words, odd, strict=True)) if a is not b and a != b]
    hits = [i for i, w in enumerate(odd) if w in fixed or w in word_odds]
    hit = set(hits)
    own = [word_odds[odd[i]] for i in hits if odd[i] in word_odds]
    begun = Counter(s for w in odd if len(w) > 4 and (s := start_of(w, start_odds)))
    starts = [start_odds[s] for s in begun.elements()]
    top = max(begun.values(), default=0)
    fixed_hits = sum(odd[i] in fixed for i in hits)
    pronouns = [i for i, w in enumerate(words) if w in second]
    near = 0.0
    if hits and pronouns:
        at = np.searchsorted(pronouns, hits)
        place = np.array(pronouns)
        gap = np.minimum(np.abs(place[np.minimum(at, len(place) - 1)] - hits), np.abs(place[np.maximum(at - 1, 0)] - hits))
        near = float(1 / (1 + gap.min()))
    letters = sum(map(len, words)) or 1
    raw = np.frombuffer(text.encode(), np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    signs = int((((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126))).sum())
    shouted = sum(w.isupper() and len(w) > 2 for w in text.split()) / n
    return [
        float(fixed_hits), fixed_hits / n, float(len(own)), len(own) / n, sum(own) / n, max(own, default=0.0),
        float(len(starts)), len(starts) / n, sum(starts) / n, max(starts, default=0.0), float(top), top / n,
        near, len(pronouns) / n, upper / letters, shouted, signs / len(raw), text.count("!") / n,
        len(changed) / n, float(sum(i in hit for i in changed)) if changed and hits else 0.0, float(np.log1p(n)),
    ]


def add_features(docs: DataFrame, lexicons: list[tuple[dict, dict]], keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and one double column a feature, of ``text``.

    Of several lexicons, that at a row's ``part`` is used.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((frozenset(INSULTS), frozenset(SECOND_PERSON), lexicons))
    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(f, T.DoubleType()) for f in FEATURES)])
    by_part = len(lexicons) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed, second, learned = shared.value
        for batch in batches:
            parts = batch.column("part").to_pylist() if by_part else [0] * batch.num_rows
            rows = [features(t, fixed, second, *learned[p]) for t, p in zip(batch.column("text").to_pylist(), parts, strict=True)]
            table = np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(table[:, i]) for i in range(len(FEATURES)))], names=[*keep, *FEATURES])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def learn_lexicons(train: DataFrame) -> list[tuple[dict, dict]]:
    """Log-odds of words and of word beginnings that mark label 1, by the number
    of documents with them among ``text, toxic, part``: for each part from the
    other parts, and last from all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, terms, labels, parts = [], [], [], []
            for text, toxic, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = {plain(w) if not w.isalpha() else w for w in words_of(text or "")}
                for kind, found in ((0, own), (1, {w[:k] for k in _STARTS for w in own if len(w) > k})):
                    terms += found
                    kinds += [kind] * len(found)
                    labels += [toxic] * len(found)
                    parts += [part] * len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(terms, pa.string()), pa.array(labels, pa.int32()), pa.array(parts, pa.int32())], names=["kind", "term", "toxic", "part"]
            )

    totals = {r["part"]: (r["one"], r["n"]) for r in train.groupBy("part").agg(F.sum("toxic").alias("one"), F.count("*").alias("n")).collect()}
    rows = train.select("text", F.col("toxic").cast("int"), "part").mapInArrow(run, "kind int, term string, toxic int, part int")
    of_part = [c for p in range(PARTS) for c in (F.sum(F.when(F.col("part") == p, F.col("toxic")).otherwise(0)).alias(f"a{p}"), F.count_if(F.col("part") == p).alias(f"b{p}"))]
    counts = materialize(rows.groupBy("kind", "term").agg(*of_part).where(sum(F.col(f"b{p}") for p in range(PARTS)) >= LEXICON_DOCS), "toxic-terms")
    out = []
    for left_out in (*range(PARTS), None):
        used = [p for p in range(PARTS) if p != left_out]
        one, n = (float(sum(totals.get(p, (0, 0))[i] for p in used)) for i in (0, 1))
        a, b = sum(F.col(f"a{p}") for p in used), sum(F.col(f"b{p}") for p in used)
        odds = F.log((a + 0.5) / (one + 1)) - F.log((b - a + 0.5) / (n - one + 1))
        z = F.col("odds") / F.sqrt(1 / (a + 0.5) + 1 / (b - a + 0.5))
        # the difference of the labels' shares in standard errors: terms that no
        # clean document has come first
        share = b / n
        gap = (a / max(1.0, one) - (b - a) / max(1.0, n - one)) / F.sqrt(share * (1 - share + 1 / n) * (1 / max(1.0, one) + 1 / max(1.0, n - one)))
        best = counts.where(b >= LEXICON_DOCS).withColumn("odds", odds).where(z >= LEXICON_Z).withColumn("gap", F.round(gap, 9))
        best = best.orderBy(F.desc("gap"), "kind", "term").limit(LEXICON_ROWS).collect()
        out.append(({r.term: r.odds for r in best if r.kind == 0}, {r.term: r.odds for r in best if r.kind == 1}))
    return out


class ToxicityModel:
    """A lexicon, boosted trees over ``FEATURES`` and an isotonic calibration."""

    def __init__(self, lexicon: tuple[dict, dict], trees, calibration, constant: float | None = None) -> None:  # noqa: ANN001
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """``keep`` and ``score`` for every row of ``docs``."""
        if self.constant is not None:
            return docs.select(*keep, F.lit(self.constant).alias("score"))
        # kept columns go together as one, whatever their names are
        table = add_features(docs.select(F.struct(*keep).alias("__kept"), "text"), [self.lexicon], ("__kept",))
        raw = self.trees.transform(_vector(table)).withColumn("margin", vector_to_array("probability")[1])
        scored = self.calibration.transform(raw)
        return scored.select("__kept.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction_cal")).alias("score"))


def _vector(table: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)


def copy_group(text: Column) -> Column:
    """The least hash of three consecutive words: near copies mostly share it."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")

    def least(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1)))
        return F.array_min(F.transform(starts, lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))))

    # as a variable of a function the words are split once
    return F.transform(F.array(words), least)[0]


def fit(labelled: DataFrame, seed: int = 7) -> ToxicityModel:
    """Learn from at most ``TRAIN_ROWS`` rows of ``doc_id, text, toxic``."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "group"), F.lit(PARTS))
    ids = labelled.select("doc_id").distinct()
    size = ids.count()
    if size > TRAIN_ROWS:  # the share of hashes that leaves about TRAIN_ROWS rows
        labelled = labelled.where(F.pmod(order, F.lit(1_000_003)) < int(1_000_003 * 0.98 * TRAIN_ROWS / size))
    # of near copies with one label one is learned from, and all are in one part
    first = F.min(F.struct(order.alias("order"), "doc_id", "text")).alias("row")
    groups = labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), copy_group(F.col("text")).alias("group")).groupBy("group", "toxic").agg(first)
    train = materialize(groups.select("row.doc_id", "row.text", "toxic", part.cast("int").alias("part")), "toxic-train")
    kinds = {(r["part"], r["toxic"]) for r in train.select("part", "toxic").distinct().collect()}
    if len({k for k in kinds if k[1] in (0, 1)}) < 2 * PARTS:
        mean = train.agg(F.avg("toxic")).first()[0]
        return ToxicityModel(({}, {}), None, None, float(mean or 0.0))
    *others, lexicon = learn_lexicons(train)
    table = materialize(_vector(add_features(train, others, ("part", "toxic"))).select("part", F.col("toxic").cast("double").alias("label"), "features"), "toxic-features")
    learned = table.where(F.col("part") < PARTS - 1).coalesce(2).persist()
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=seed, maxBins=64).fit(learned)
    learned.unpersist()
    held = trees.transform(table.where(F.col("part") == PARTS - 1)).select(vector_to_array("probability")[1].alias("margin"), "label")
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="prediction_cal").fit(held.coalesce(1))
    return ToxicityModel(lexicon, trees, calibration)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the contract's columns for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    open_labels = labels.where(~held_out & F.col("toxic").isin(0, 1))
    size = open_labels.count()
    if size > TRAIN_ROWS:  # fewer rows to look texts up for; fit() bounds them as well
        share = int(1_000_003 * 0.98 * TRAIN_ROWS / size)
        open_labels = open_labels.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_003)) < share)
    model = fit(docs.join(F.broadcast(open_labels), "doc_id"))  # at most about TRAIN_ROWS labels
    return model.score(docs, ("doc_id",)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
