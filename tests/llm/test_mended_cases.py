"""Cases that were once wrong: overlapping spans, ids that are null or repeat, long texts."""

import collections
import importlib.util
import random
import time

import pytest
from pyspark.sql import functions as F

from cargolore.llm import decontaminate, language_id, line_dedup, pii, substring_dedup, toxicity

# op1


def test_every_span_that_passes_is_kept_or_overlapped(spark):
    r = random.Random(11)
    pieces = ["foo at bar dot com", "abcdefghijklmnop1", "/", "030 1234 5678", "555-123-4567", "12345678901", " ", "x", "token=", "9b0b3c6a43eb78aa99cb", "ssn 536-22-8726", "DE89 3704 0044", "(555) 12 ", "."]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(2, 14))) for _ in range(300)]
    texts.append("mail foo at bar dot abcdefghijklmnop1/030 1234 5678 end")
    scores = "CASE WHEN length(x.g.m) % 3 = 0 THEN 0.9D WHEN length(x.g.m) % 3 = 1 THEN 0.8D ELSE 0.7D END"
    model = pii.SpanModel(scores, dict.fromkeys(pii.KINDS, 0.5))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chained = 0
    for row in pii.detect(df, model).collect():
        kept = sorted((x.s, x.e) for x in row.added)
        assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:], strict=False))
        assert set(kept) <= {(p.s, p.e) for p in row.passed}
        assert all(any(s < p.e and p.s < e for s, e in kept) for p in row.passed)
        chained += len(row.passed) > len(kept) + 1
    assert chained > 20
    hidden = {x.doc_id: x.text for x in pii.redact(df, model).collect()}
    for row in pii.detect(df, model).collect():
        bare = [c for i, c in enumerate(texts[row.doc_id]) if not any(p.s <= i < p.e for p in [*row.passed, *row.base])]
        assert hidden[row.doc_id].replace("[REDACTED]", "") == "".join(bare)


# op3


def test_lines_of_texts_without_an_id(spark):
    """Texts without an id own last and each loses only its own lines."""
    r = random.Random(3)
    lines = [f"a line of text number {i}" for i in range(30)]
    rows = [(None if i % 3 == 0 else i % 40, "\n".join(r.choice(lines) for _ in range(5))) for i in range(300)]
    last = 2**63 - 1
    held = collections.defaultdict(set)
    for i, text in rows:
        for line in text.split("\n"):
            held[line].add(last if i is None else i)
    want = []
    for i, text in rows:
        own = last if i is None else i
        kept = [x for x in text.split("\n") if len(held[x]) < 2 or min(held[x]) == own]
        want.append((i, 5, 5 - len(kept), "\n".join(kept)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    keys = line_dedup.line_keys(docs)
    assert keys.where(f"doc_id = {last}").select("part").distinct().count() > 90
    assert keys.where(f"doc_id < {last}").select("part").distinct().count() == 1


# op4


def test_items_that_share_a_window_are_listed_in_linear_time():
    shared = " ".join(f"w{i}" for i in range(13))
    began = time.time()
    found = decontaminate.benchmark_windows([(f"i{n}", f"{shared} end{n}") for n in range(20_000)], 13)
    assert time.time() - began < 20 and max(map(len, found["items"])) == 20_000


# op7


def test_features_of_ten_megabytes():
    text = "y0u st0pid 1diot " * 600_000
    began = time.time()
    few = toxicity.features(text[:17_000], frozenset(toxicity.INSULTS), frozenset(toxicity.SECOND_PERSON), {}, {})
    many = toxicity.features(text, frozenset(toxicity.INSULTS), frozenset(toxicity.SECOND_PERSON), {}, {})
    assert len(few) == len(many) and time.time() - began < 120


# op9


def test_declared_languages_of_three_letters(spark):
    pages = spark.createDataFrame([(1, "http://a.x/", "<html lang='ast-ES'>"), (2, "http://a.x/", "<html lang=EN_us>")], "page_id long, url string, html string")
    got = pages.select("page_id", language_id.page_columns()["declared"].alias("d")).collect()
    assert {r.page_id: r.d for r in got} == {1: "ast", 2: "EN"}


# the pipeline


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was removed")
def test_pipeline_keeps_one_row_of_each_group(spark, tmp_path):
    import corpus_pipeline

    a, b = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40))
    c = " ".join(f"gamma{i}" for i in range(40))
    rows = [(1, a), (2, a), (2, b), (3, b + " word"), (None, a), (None, c), (None, c), (5, "short own text here now"), (5, "short own text here now"), (7, None), (8, ""), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = collections.Counter([(1, a), (2, b), (None, c), (5, "short own text here now"), (7, None), (8, ""), (None, None)])
    assert collections.Counter(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect())) == want
    # rows that are not of files are numbered all the same
    made = docs.groupBy("doc_id", "text").count().selectExpr("doc_id", "text", "explode(sequence(1, int(count))) AS n").drop("n")
    assert collections.Counter(map(tuple, corpus_pipeline.near_duplicates(spark, made, "").collect())) == want
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), "").count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was removed")
def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_jaccard_bands_are_met_without_signatures(spark, monkeypatch):
    """A band's row has 125 bytes less before its bucket is known to be shared."""
    from cargolore.llm import jaccard_join as jj

    seen, plain = [], jj.hot_join
    monkeypatch.setattr(jj, "hot_join", lambda left, *rest, **named: seen.append(left.columns) or plain(left, *rest, **named))
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i // 2}") for i in range(6)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in jj.jaccard_join(docs).collect()) == [(i, i - i % 2) for i in range(6)]
    assert [c for c in seen if "bucket" in c] and all("sign" not in c for c in seen if "bucket" in c)


def test_a_shard_is_not_built_again_for_few_words(spark, monkeypatch):
    """650,000 words that visit one shard are streamed through one automaton."""
    shared = " ".join(f"word{i:04d}" for i in range(5000))
    docs = spark.range(130).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared + " own"), F.col("id").cast("string")).alias("text"))
    built, plain = spark.sparkContext.accumulator(0), substring_dedup._match

    def match(size):
        run = plain(size)
        return lambda reference, passages: (built.add(int(bool(reference.num_rows and passages.num_rows))), run(reference, passages))[1]

    monkeypatch.setattr(substring_dedup, "_match", match)
    got = substring_dedup.dedup_substrings(docs).collect()
    assert {(r.doc_id, r.text, r.n_words, r.n_removed) for r in got} == {(i, f"own{i}", 5001, 5000) for i in range(130)}
    assert built.value == 1
