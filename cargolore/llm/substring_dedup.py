"""Substring deduplication with suffix automata of reference shards.

A window is ``size`` consecutive words of one document.  Every word inside a
window that starts anywhere else as well is removed, in all its places.

1. *Anchors.*  Of each window's ``GRAM``-word hashes the least is its anchor, so
   equal windows have equal anchors.  Anchors are counted over all documents; a
   window whose anchor has one place is unique and is not looked at again.
   Runs of the other windows are *passages*.
2. *Reference.*  The windows of all passages are counted by a 96-bit hash, with
   partial sums before the shuffle; so it is this count that decides which windows
   repeat, and the automata below that find where.  Each repeated window belongs to one of the
   documents that hold it; chains of a document's windows are the reference, in
   which each repeated word sequence stands once however often it occurs.
3. *Shards.*  The reference is cut into shards of about ``SHARD_WORDS`` words, so
   that what one group of near copies shares is in one shard; a group whose
   reference outgrows a shard is spread over several.  A shard's suffix automaton
   is built in the tasks it is sent to, and passages stream through it for their matching statistics: at each word, the
   length of the longest match that ends there.  Where it reaches ``size``, the
   span is removed.  A passage only visits the shards that hold one of its
   windows' routes (sending every document to every shard would grow with the square of
   the corpus), and a shard with much to match is sent to several tasks.

Words are runs of anything but ASCII white space, unchanged.  Defined cases: a
null or empty text has no words; a text of under ``size`` words loses none; rows
with equal ids and texts are two places of the same windows; null ids are ids.
An empty table gives no rows.  Columns other than ``doc_id`` and ``text`` are
passed on unread; a column with the name of an added one is replaced.  Names
that begin with two underscores are reserved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolore.llm.common import Words, chunks, grams, hot_join, materialize, mix, text_buffer

#: Words of a window.
SIZE = 35
#: Words of the hashes that anchors are chosen from.
GRAM = 8
#: Words of a reference shard, about: its automaton takes some 60 MB.
SHARD_WORDS = 100_000
#: Words that one task streams through a shard, about.  To build a shard's automaton takes as
#: long as to stream some 700,000 words, so that fewer words a task build it more often than they save.
TASK_WORDS = 2_000_000
#: Loads of up to so many shards are sent to all executors, with the large groups
#: (a group needs a shard's words, so at most ``SIZE`` times as many): some 28 MB.
BROADCAST_SHARDS = 50_000


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:  # noqa: ANN001
    """``pick`` (np.minimum or np.maximum) over each ``width`` consecutive values."""
    out, size = values, 1
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    return pick(out[: len(values) - width + 1], out[width - size :]) if width > size else out


def window_anchors(words: Words, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window in one document: its first word's place, its document's
    place, and its anchor.  Also usable where no document has ``size`` words."""
    many = np.maximum(words.counts - size + 1, 0)
    n = int(many.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begin = np.cumsum(words.counts) - words.counts
    place = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(n)
    least = _sliding(grams(words.hashes, gram), size - gram + 1, np.minimum)
    return place, np.repeat(np.arange(len(many)), many), least[place]


def window_routes(words: Words, place: np.ndarray, size: int = SIZE, gram: int = GRAM) -> np.ndarray:
    """Of each window, by its first word's place, the hash of the least grams of
    both its halves.  Like anchors they are equal for equal windows and change
    every few words, but a frequent phrase in a window does not decide them alone.
    """
    width = (size - gram + 1) // 2
    least = _sliding(grams(words.hashes, gram), width, np.minimum)
    return mix(least[place] * np.uint64(0xD6E8FEB86659FD93) + least[place + size - gram + 1 - width])


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    data, ends = text_buffer(batch.column("text"))
    for first, last in chunks(ends):
        base = ends[first - 1] if first else 0
        yield first, last, Words(data[base : ends[last - 1]], ends[first:last] - base, "plain")


def _anchor_rows(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for first, _, words in _pieces(batch):
                place, doc, anchor = window_anchors(words, size)
                if not len(place):
                    continue
                # the places of anchors: grams that are the least of a window of theirs
                gram = grams(words.hashes, GRAM)
                width = size - GRAM + 1
                padded = np.zeros(len(gram) + width - 1, np.uint64)
                padded[place + width - 1] = anchor
                at = np.flatnonzero(_sliding(padded, width, np.maximum) == gram)
                own = keys[first:][np.searchsorted(np.cumsum(words.counts), at, side="right")]
                value = gram[at]
                order = np.lexsort((own, value))
                own, value = own[order], value[order]
                new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (value[1:] != value[:-1])))
                yield pa.RecordBatch.from_pydict({
                    "anchor": pa.array(value[new].view(np.int64)), "key": pa.array(own[new]),
                    "places": pa.array(np.diff(np.append(new, len(own))).astype(np.int64)),
                })

    return run


def _runs(flags: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of windows (first, after the last) with a flag and consecutive places."""
    at = np.flatnonzero(flags)
    if len(at):
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(place[at]) != 1))
        yield from zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + 1).tolist(), strict=True)


def _passages(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, others, texts = batch.column("key").to_numpy(), batch.column("other").to_numpy(), batch.column("text")
            found, homes = batch.column("anchors"), batch.column("home").to_numpy()
            out: dict[str, list] = {"key": [], "other": [], "home": [], "start": [], "text": []}
            for first, last, words in _pieces(batch):
                place, doc, anchor = window_anchors(words, size)
                begin = np.cumsum(words.counts) - words.counts
                edge = np.searchsorted(doc, np.arange(last - first + 1))
                for d in range(last - first):
                    a, b = edge[d], edge[d + 1]
                    if a == b:
                        continue
                    repeated = np.asarray(found[first + d].values).view(np.uint64)
                    flags = np.isin(anchor[a:b], repeated)
                    own = None
                    for x, y in _runs(flags, place[a:b]):
                        own = own or texts[first + d].as_py().encode().split()
                        start = int(place[a + x] - begin[d])
                        out["key"].append(keys[first + d])
                        out["other"].append(others[first + d])
                        out["home"].append(homes[first + d])
                        out["start"].append(start)
                        out["text"].append(b" ".join(own[start : start + y - x + size - 1]))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(out["key"], pa.int64()), "other": pa.array(out["other"], pa.int64()), "home": pa.array(out["home"], pa.int64()),
                "start": pa.array(out["start"], pa.int32()), "text": pa.array(out["text"], pa.binary()).cast(pa.string()),
            })

    return run


def _window_hashes(words: Words, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each window: its words' hashes, put together in two ways."""
    one = grams(words.hashes, size)[place]
    two = grams(words.hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5), size)[place]
    return one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _window_rows(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for first, _, words in _pieces(batch):
                place, doc, _ = window_anchors(words, size)
                if len(place):
                    h1, h2 = _window_hashes(words, place, size)
                    yield pa.RecordBatch.from_pydict({"h1": pa.array(h1), "h2": pa.array(h2), "key": pa.array(keys[first:][doc])})

    return run


def _held(h1: np.ndarray, h2: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which hashes ``h1, h2`` are among those of ``one, two``, by all 96 bits."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    at = np.minimum(np.searchsorted(one, h1), len(one) - 1)
    out = (one[at] == h1) & (two[at] == h2)
    for k in np.flatnonzero((one[at] == h1) & ~out):  # equal in 64 bits only, or a later one of these
        out[k] = bool(((one == h1[k]) & (two == h2[k])).any())
    return out


def _reference_rows(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes, texts, found, more = batch.column("home").to_numpy(), batch.column("text"), batch.column("hashes"), batch.column("more")
            out: dict[str, list] = {"home": [], "text": [], "routes": []}
            for first, last, words in _pieces(batch):
                place, doc, _ = window_anchors(words, size)
                if not len(place):
                    continue
                h1, h2 = _window_hashes(words, place, size)
                route = window_routes(words, place, size)
                begin = np.cumsum(words.counts) - words.counts
                edge = np.searchsorted(doc, np.arange(last - first + 1))
                for d in range(last - first):
                    a, b = edge[d], edge[d + 1]
                    own = None
                    for x, y in _runs(_held(h1[a:b], h2[a:b], np.asarray(found[first + d].values), np.asarray(more[first + d].values)), place[a:b]):
                        own = own or texts[first + d].as_py().encode().split()
                        start = int(place[a + x] - begin[d])
                        out["home"].append(homes[first + d])
                        out["text"].append(b" ".join(own[start : start + y - x + size - 1]))
                        out["routes"].append(np.unique(route[a + x : a + y]).view(np.int64))
            yield pa.RecordBatch.from_pydict({"home": pa.array(out["home"], pa.int64()), "text": pa.array(out["text"], pa.binary()).cast(pa.string()), "routes": pa.array(out["routes"], pa.list_(pa.int64()))})

    return run


def _passage_routes(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts = batch.column("key").to_numpy(), batch.column("start").to_numpy()
            for first, _, words in _pieces(batch):
                place, doc, _ = window_anchors(words, size)
                if len(doc):
                    route = window_routes(words, place, size)
                    order = np.lexsort((route, doc))
                    doc, route = doc[order], route[order]
                    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (route[1:] != route[:-1])))
                    at = first + doc[new]
                    yield pa.RecordBatch.from_pydict({"route": pa.array(route[new].view(np.int64)), "key": pa.array(keys[at]), "start": pa.array(starts[at])})

    return run


class SuffixAutomaton:
    """The suffix automaton of some word sequences: every run of words that
    occurs in one of them is a path from state 0."""

    def __init__(self) -> None:
        self.go: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        """Add one sequence; matches never cross from one to the next."""
        go, link, length = self.go, self.link, self.length
        last = 0
        for w in words:
            q = go[last].get(w)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, w)
                continue
            state = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0:
                q = go[p].setdefault(w, state)
                if q != state:
                    link[state] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
                    break
                p = link[p]
            last = state

    def _clone(self, p: int, q: int, w) -> int:  # noqa: ANN001
        go, link, length = self.go, self.link, self.length
        copy = len(go)
        go.append(dict(go[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and go[p].get(w) == q:
            go[p][w] = copy
            p = link[p]
        return copy

    def spans(self, words: list, size: int) -> list[tuple[int, int]]:
        """Maximal ranges of words covered by matches of at least ``size`` words."""
        go, link, length = self.go, self.link, self.length
        state = match = 0
        out: list[tuple[int, int]] = []
        for i, w in enumerate(words):
            while (to := go[state].get(w)) is None and state:
                state = link[state]
                match = length[state]
            if to is None:
                continue
            state = to
            match += 1
            if match >= size:
                if out and i - size + 1 <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i - size + 1, i + 1))
        return out


def _match(size: int):  # noqa: ANN202
    def run(reference: pa.Table, passages: pa.Table) -> pa.Table:
        out: dict[str, list] = {"key": [], "other": [], "begins": [], "stops": []}
        seen: dict[str, list] = {}
        if reference.num_rows and passages.num_rows:
            automaton = SuffixAutomaton()
            for text in reference["text"].to_pylist():
                automaton.add(text.encode().split())
            for key, other, start, text in zip(*(passages[c].to_pylist() for c in ("key", "other", "start", "text")), strict=True):
                found = seen.get(text)  # copies of a passage are streamed once
                if found is None:
                    found = seen[text] = automaton.spans(text.encode().split(), size)
                if found:
                    out["key"].append(key)
                    out["other"].append(other)
                    out["begins"].append([start + a for a, _ in found])
                    out["stops"].append([start + b for _, b in found])
        return pa.table({"key": pa.array(out["key"], pa.int64()), "other": pa.array(out["other"], pa.int64()), "begins": pa.array(out["begins"], pa.list_(pa.int32())), "stops": pa.array(out["stops"], pa.list_(pa.int32()))})

    return run


def match_reference(passages: DataFrame, reference: DataFrame, shards: int, size: int = SIZE) -> DataFrame:
    """Stream ``key, other, start, text`` through the automata of ``home, text, routes``
    (reference texts of one home are in one shard, or in several once they have
    over ``SHARD_WORDS`` words).

    Returns ``key, other, begins, stops``: ranges of words, counted from the
    document's start, that are covered by matches of ``size`` words.
    """
    large = reference.groupBy("home").agg(F.ceil(F.sum(F.length("text")) / (6 * SHARD_WORDS)).alias("parts")).where("parts > 1")
    large = F.broadcast(large) if shards <= BROADCAST_SHARDS else large
    part = F.pmod(F.xxhash64("text"), F.coalesce("parts", F.lit(1)))
    reference = reference.join(large, "home", "left").withColumn("shard", F.pmod(F.xxhash64("home", part), F.lit(shards)).cast("int"))
    homes = reference.select(F.explode("routes").alias("route"), "shard").distinct()
    at = passages.mapInArrow(_passage_routes(size), "route bigint, key bigint, start int")
    visits = at.join(homes, "route").select("key", "start", "shard").distinct()
    routed = materialize(passages.select("key", "other", "start", "text").join(visits, ["key", "start"]), "routed")
    load = routed.groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / (6 * TASK_WORDS)).cast("int").alias("salts"))
    load = F.broadcast(load) if shards <= BROADCAST_SHARDS else load
    salted = routed.join(load, "shard").withColumn("salt", F.pmod(F.xxhash64("key", "start"), F.col("salts")).cast("int"))
    copies = reference.join(load, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    left = copies.select("shard", "salt", "text").groupBy("shard", "salt")
    right = salted.select("shard", "salt", "key", "other", "start", "text").groupBy("shard", "salt")
    return left.cogroup(right).applyInArrow(_match(size), "key bigint, other bigint, begins array<int>, stops array<int>")


def repeated_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``key, other, begins, stops`` of ``docs`` with ``key, other, text``: the words in
    repeated windows.

    ``key`` and ``other`` are two hashes of a document.  Documents that share a key
    but not the other hash are looked at under each other's anchors, which changes
    nothing, and their spans are told apart by ``other``."""
    occurrences = materialize(docs.mapInArrow(_anchor_rows(size), "anchor bigint, key bigint, places bigint"), "anchors")
    repeated = occurrences.groupBy("anchor").agg(F.sum("places").alias("n"), F.min("key").alias("first"), F.count("*").alias("docs")).where("n > 1")
    repeated = materialize(repeated.select("anchor", "first", "docs"), "repeated")
    # a document's home: the first document of most of its repeated anchors.  Near
    # copies have one home, so what they share is in one shard.
    met = hot_join(occurrences.select("anchor", "key"), repeated, ["anchor"], "docs", F.xxhash64("key"))
    by_doc = met.groupBy("key").agg(F.collect_list("anchor").alias("anchors"), F.mode("first", True).alias("home"))
    by_doc = materialize(by_doc, "repeated-anchors")
    passages = docs.join(by_doc, "key").mapInArrow(_passages(size), "key bigint, other bigint, home bigint, start int, text string")
    passages = materialize(passages, "passages")
    windows = passages.mapInArrow(_window_rows(size), "h1 bigint, h2 int, key bigint")
    owned = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n > 1")
    owned = materialize(owned.groupBy("key").agg(F.collect_list(F.struct("h1", "h2")).alias("h")).select("key", F.col("h.h1").alias("hashes"), F.col("h.h2").alias("more")), "windows")
    reference = materialize(passages.join(owned, "key").mapInArrow(_reference_rows(size), "home bigint, text string, routes array<bigint>"), "reference")
    total = owned.agg(F.sum(F.size("hashes"))).first()[0] or 0
    return match_reference(passages, reference, max(1, math.ceil(total / SHARD_WORDS)), size)


def dedup_substrings(docs: DataFrame, *, size: int = SIZE) -> DataFrame:
    """``docs`` with ``text`` reduced to the words that are left, joined by one
    space, and ``n_words`` (before), ``n_removed``."""
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    keyed = docs.withColumns({"__key": F.xxhash64("doc_id", "text"), "__other": F.xxhash64(F.lit(35), F.col("doc_id"), F.col("text"))})
    spans = repeated_spans(keyed.select(F.col("__key").alias("key"), F.col("__other").alias("other"), "text"), size)
    spans = spans.groupBy("key", "other").agg(F.flatten(F.collect_list("begins")).alias("__begins"), F.flatten(F.collect_list("stops")).alias("__stops"))
    spans = materialize(spans, "spans")
    spans = spans.withColumnsRenamed({"key": "__span_key", "other": "__span_other"})
    joined = keyed.join(spans, (F.col("__key") == F.col("__span_key")) & (F.col("__other") == F.col("__span_other")), "left").select(*kept, "__begins", "__stops")
    out = docs.select(*kept).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts, before, removed = [], [], []
            for text, begins, stops in zip(table["text"].to_pylist(), table["__begins"].to_pylist(), table["__stops"].to_pylist(), strict=True):
                words = (text or "").encode().split()
                gone = 0
                if begins:
                    cover = np.zeros(len(words) + 1, np.int32)
                    np.add.at(cover, begins, 1)
                    np.add.at(cover, stops, -1)
                    left = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                    gone = len(words) - len(left)
                    texts.append(b" ".join([words[i] for i in left]).decode())
                else:
                    texts.append(b" ".join(words).decode())
                before.append(len(words))
                removed.append(gone)
            table = table.drop_columns(["__begins", "__stops"])
            table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            table = table.append_column("n_words", pa.array(before, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))
            yield from table.combine_chunks().to_batches()

    return joined.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the contract's columns for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS u(i) WHERE len(w) >= 35),
r AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
g AS (SELECT doc_id, i FROM x JOIN r USING (h)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM g),
p AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
k AS (SELECT doc_id, count(*) FILTER (c.i IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY p.i) FILTER (c.i IS NULL) AS kept FROM p LEFT JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
