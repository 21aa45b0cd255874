"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each segment holds, for some thousands of
documents, every term's sorted list of positions (a posting list).  A benchmark
is cut into windows of ``width`` words.  In each segment the lists of a
window's terms are intersected after subtracting each term's offset, from the
segment's rarest term on, so the long lists of frequent words are only ever
probed at the few places that the rarer terms have left.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after A-Z is
lower-cased.  Terms are 64-bit hashes of words.

Defined cases: a null or empty text has no words and no hits; a document whose
id is null, or that is repeated, yields one row for each of its rows; a
benchmark item without words matches nothing, and a shorter one than ``width``
is one window; items may have ids of any type, which are told as text, and rows
with equal ids are one item; an empty benchmark leaves every document clean.
Other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolore.llm.common import Words, chunks, materialize, text_buffer

#: Words of a benchmark that are searched for at once; a larger one takes more passes.
BLOCK_WORDS = 2_000_000
#: Text bytes of one segment, about (a longer document is a segment of its own).
SEGMENT_BYTES = 4_000_000

_INDEX = "rows array<bigint>, doc_ids array<bigint>, doc_ends array<int>, terms array<bigint>, ends array<int>, positions binary"
_MATCH = "row bigint, doc_id bigint, n_words bigint, hit_starts array<int>, hit_ends array<int>, item_ids array<string>, near_item_ids array<string>"
#: More words than the window's that a proximity match of the query may span.
NEAR_SLOP = 3
#: Places of rarest terms that proximity is tested for at once.
_PLACES = 50_000


def build_index(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Segments of the positional index over every word of every document.

    One row a segment: ``rows``, numbers that tell the input's rows apart (the
    column ``row`` if given, else made here), ``doc_ids`` and the running count of words after each
    (``doc_ends``); ``terms`` in ascending order, the running count of postings
    after each (``ends``), and all ``positions`` as zstd-compressed 32-bit
    differences.  Write it with ``.write.parquet`` to search it again later.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, ends = text_buffer(batch.column("text"))
            rows, ids = batch.column("row"), batch.column("doc_id")
            for first, last in chunks(ends, SEGMENT_BYTES):
                base = ends[first - 1] if first else 0
                words = Words(data[base : ends[last - 1]], ends[first:last] - base, "folded")
                order = np.argsort(words.hashes, kind="stable").astype(np.int32)
                found = words.hashes[order]
                new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
                steps = np.diff(order, prepend=np.int32(0)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "rows": pa.array([rows.slice(first, last - first).to_pylist()], pa.list_(pa.int64())),
                    "doc_ids": pa.array([ids.slice(first, last - first).to_pylist()], pa.list_(pa.int64())),
                    "doc_ends": pa.array([np.cumsum(words.counts).astype(np.int32)], pa.list_(pa.int32())),
                    "terms": pa.array([found[new].view(np.int64)], pa.list_(pa.int64())),
                    "ends": pa.array([np.append(new[1:], len(found)).astype(np.int32)[: len(new)]], pa.list_(pa.int32())),
                    "positions": pa.array([pack.compress(steps.tobytes())], pa.binary()),
                })

    number = F.monotonically_increasing_id() if row is None else F.col(row)
    return docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(segments, _INDEX)


def benchmark_windows(items: list[tuple[str, str | None]], width: int) -> dict:
    """The distinct windows of some benchmark items, and whose each one is.

    ``windows``: for each number of words, the windows' terms, one a row, and
    their places in ``items``, the lists of item ids.
    """
    seen: dict[bytes, int] = {}
    owners: list[dict[str, None]] = []
    rows: dict[int, list[np.ndarray]] = {}
    places: dict[int, list[int]] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        terms = Words(raw, np.array([len(raw)]), "folded").hashes
        size = min(width, len(terms))
        for i in range(len(terms) - size + 1 if size else 0):
            row = terms[i : i + size]
            at = seen.setdefault(row.tobytes(), len(owners))
            if at == len(owners):
                owners.append({})
                rows.setdefault(size, []).append(row)
                places.setdefault(size, []).append(at)
            owners[at][item] = None
    return {"windows": {k: (np.stack(v), np.array(places[k])) for k, v in rows.items()}, "items": [list(x) for x in owners]}


def _phrases(index: dict, windows: np.ndarray, token: np.ndarray, doc_of: np.ndarray, slop: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows (row numbers) and first positions where all offset-adjusted lists
    meet; and windows and documents where all terms lie within ``slop`` more positions."""
    terms, begin, count, positions = index["terms"], index["begin"], index["count"], index["positions"]
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(windows):
        return none, none, none, none
    at = np.minimum(np.searchsorted(terms, windows), len(terms) - 1)
    rows = np.flatnonzero((terms[at] == windows).all(axis=1))
    at, size = at[rows], windows.shape[1]
    if not len(rows):
        return none, none, none, none
    order = np.argsort(count[at], axis=1, kind="stable")
    ranks = np.arange(len(rows))
    rare = at[ranks, order[:, 0]]
    row = np.repeat(ranks, count[rare])
    inner = np.arange(len(row)) - np.repeat(np.cumsum(count[rare]) - count[rare], count[rare])
    anchor = positions[begin[rare][row] + inner]
    start, live = anchor - order[row, 0], row
    keep = (start >= 0) & (start + size <= len(token))
    start, live = start[keep], live[keep]
    keep = doc_of[start] == doc_of[start + size - 1]
    start, live = start[keep], live[keep]
    for r in range(1, size):
        offset = order[live, r]
        keep = token[start + offset] == at[live, offset]
        start, live = start[keep], live[keep]
    near_rows, near_docs = [none], [none]
    for k in range(0, len(row) if slop is not None else 0, _PLACES):
        own, place = row[k : k + _PLACES], anchor[k : k + _PLACES]
        close = _close(at[own], order[own], place, token, doc_of, size - 1 + slop)
        near_rows.append(rows[own[close]])
        near_docs.append(doc_of[place[close]].astype(np.int64))
    return rows[live], start, np.concatenate(near_rows), np.concatenate(near_docs)


def _close(terms: np.ndarray, order: np.ndarray, place: np.ndarray, token: np.ndarray, doc_of: np.ndarray, reach: int) -> np.ndarray:
    """Of places of the rarest term, those that some run of ``reach + 1`` words of the
    document around them holds together with all other terms of the row."""
    live = np.arange(len(place))
    around = place[:, None] + np.arange(-reach, reach + 1)[None, :]
    inside = np.clip(around, 0, len(token) - 1)
    found = np.where((around == inside) & (doc_of[inside] == doc_of[place][:, None]), token[inside], -1)
    # for each of the runs that hold the place, whether all terms so far are in it
    runs = np.ones((len(place), reach + 1), bool)
    for r in range(1, terms.shape[1]):
        here = found == terms[live, order[live, r]][:, None]
        some = here.any(axis=1)
        live, found, here, runs = live[some], found[some], here[some], runs[some]
        if not len(live):
            break
        total = np.cumsum(np.pad(here, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
        runs &= total[:, reach + 1 :] > total[:, : reach + 1]
        some = runs.any(axis=1)
        live, found, runs = live[some], found[some], runs[some]
    return live


def search(index: DataFrame, benchmark: DataFrame, *, width: int = 13, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Exact phrase matches, and proximity matches if ``slop`` is given.

    Returns one row a document (by ``row``) and block of the benchmark: ``n_words``, the
    merged ranges of words inside matching windows (``hit_starts``, exclusive
    ``hit_ends``), ``item_ids`` with a phrase match, and ``near_item_ids``: items
    with a window whose words all occur, in any order, among ``width + slop``
    consecutive words of the document.

    The benchmark's words are counted first.  Up to ``block_words`` of them go
    to all executors; a larger benchmark is cut into blocks by hash of its ids,
    each searched in a pass of its own over the index.
    """
    spark = index.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL")
    total = items.select(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = 1 + int(total // block_words)
    found = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(benchmark_windows([(r.item_id, r.text) for r in own.toLocalIterator()], width))
        one = index.mapInArrow(_searcher(shared, slop), _MATCH)
        found = one if found is None else found.unionByName(one)
    return found


def _searcher(shared, slop):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, unpack = shared.value, zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                col = {n: batch.column(n)[i] for n in batch.schema.names}
                rows, ids = col["rows"].values, col["doc_ids"].values
                doc_ends = np.asarray(col["doc_ends"].values, dtype=np.int64)
                ends = np.asarray(col["ends"].values, dtype=np.int64)
                positions = np.cumsum(np.frombuffer(unpack.decompress(col["positions"].as_py()), np.int32), dtype=np.int64)
                count = np.diff(ends, prepend=0)
                index = {"terms": np.asarray(col["terms"].values).view(np.uint64), "begin": ends - count, "count": count, "positions": positions}
                n = len(positions)
                token = np.empty(n, np.int32)
                token[positions] = np.repeat(np.arange(len(count), dtype=np.int32), count)
                doc_of = np.repeat(np.arange(len(doc_ends), dtype=np.int32), np.diff(doc_ends, prepend=0))
                cover = np.zeros(n + 1, np.int32)
                exact: list[set] = [set() for _ in doc_ends]
                near: list[set] = [set() for _ in doc_ends]
                for size, (windows, places) in wanted["windows"].items():
                    row, start, near_row, near_doc = _phrases(index, windows, token, doc_of, slop)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + size, -1)
                    for d, p in set(zip(doc_of[start].tolist(), places[row].tolist(), strict=True)):
                        exact[d].update(wanted["items"][p])
                    for d, p in set(zip(near_doc.tolist(), places[near_row].tolist(), strict=True)):
                        near[d].update(wanted["items"][p])
                hit = np.cumsum(cover[:-1]) > 0
                edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
                fresh = np.concatenate([[False], doc_of[1:] != doc_of[:-1]]) if n else np.zeros(0, bool)
                split = np.flatnonzero(fresh & hit & np.concatenate([[False], hit[:-1]])) if n else np.zeros(0, np.int64)
                starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), split]))
                stops = np.sort(np.concatenate([np.flatnonzero(edge == -1), split]))
                owner = doc_of[starts] if len(starts) else np.zeros(0, np.int32)
                first = doc_ends - np.diff(doc_ends, prepend=0)
                cuts = np.searchsorted(owner, np.arange(len(doc_ends) + 1))
                base = np.repeat(first, np.diff(cuts))
                offsets = pa.array(cuts.astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "row": rows,
                    "doc_id": ids,
                    "n_words": pa.array(np.diff(doc_ends, prepend=0)),
                    "hit_starts": pa.ListArray.from_arrays(offsets, pa.array((starts - base).astype(np.int32))),
                    "hit_ends": pa.ListArray.from_arrays(offsets, pa.array((stops - base).astype(np.int32))),
                    "item_ids": pa.array([sorted(x) for x in exact], pa.list_(pa.string())),
                    "near_item_ids": pa.array([sorted(x | y) for x, y in zip(exact, near, strict=True)] if slop is not None else [[] for _ in exact], pa.list_(pa.string())),
                })

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, share: int = 20, slop: int | None = None, block_words: int = BLOCK_WORDS, row: str | None = None) -> DataFrame:
    """One row a document: ``row, doc_id, n_words, n_hit, item_ids, near_item_ids,
    hit_starts, hit_ends, contaminated``.

    A word inside any occurrence of a window is hit; a document is contaminated
    if at least one word in ``share`` is.  ``row`` may name a column of numbers
    that tell the rows of ``docs`` apart, as ids need not.  The index is written to the shared
    scratch folder and searched from there.
    """
    found = search(materialize(build_index(docs, row), "index"), benchmark, width=width, slop=slop, block_words=block_words)
    words = F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    total = benchmark.select(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    if total // block_words:
        found = _merged(found)
    return found.withColumn("n_hit", words).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def _merged(found: DataFrame) -> DataFrame:
    """The blocks' matches of each row put together; ranges are united."""
    pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_starts", "hit_ends"))))
    joined = (
        found.groupBy("row", "doc_id", "n_words")
        .agg(pairs.alias("p"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("item_ids", "near_item_ids")))
    )
    empty = F.array().cast("array<int>")

    def step(a, x):  # noqa: ANN001, ANN202
        touch = F.size(a["e"]) > 0
        last = F.element_at(a["e"], -1)
        return F.when(
            touch & (last >= x["hit_starts"]),
            F.struct(a["s"].alias("s"), F.concat(F.slice(a["e"], 1, F.size(a["e"]) - 1), F.array(F.greatest(last, x["hit_ends"]))).alias("e")),
        ).otherwise(F.struct(F.concat(a["s"], F.array(x["hit_starts"])).alias("s"), F.concat(a["e"], F.array(x["hit_ends"])).alias("e")))

    spans = F.aggregate("p", F.struct(empty.alias("s"), empty.alias("e")), step)
    return joined.withColumn("spans", spans).select("row", "doc_id", "n_words", F.col("spans.s").alias("hit_starts"), F.col("spans.e").alias("hit_ends"), "item_ids", "near_item_ids")


def query(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """op4: the contract's columns for every document, and ``n_near, near_sha256``:
    the items of which all words of a window stand, in any order, among as many and
    ``NEAR_SLOP`` more consecutive words."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=NEAR_SLOP)

    def told(column: str) -> list:
        name = column.removesuffix("item_ids") or "items_"
        return [F.size(column).cast("long").alias(f"n_{name.rstrip('_')}"), F.sha2(F.array_join(F.array_sort(column), ","), 256).alias(f"{name}sha256")]

    return found.select("doc_id", "n_words", "n_hit", *told("item_ids"), "contaminated", *told("near_item_ids"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
       FROM b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM d, ks, unnest(range(1, len(w) - k + 2)) AS u(i) WHERE len(w) >= k),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
tf AS (SELECT word, count(*) AS n FROM pos GROUP BY word),
bs AS (SELECT item_id, k, list_distinct(string_split(s, ' ')) AS ws FROM bw),
bt AS (SELECT item_id, k, ws, arg_min(word, coalesce(tf.n, 0)) AS rare FROM (SELECT item_id, k, ws, unnest(ws) AS word FROM bs) LEFT JOIN tf USING (word) GROUP BY item_id, k, ws),
nr AS (SELECT DISTINCT pos.doc_id, bt.item_id::VARCHAR AS x FROM bt JOIN pos ON pos.word = bt.rare JOIN d ON d.doc_id = pos.doc_id, unnest(range(greatest(1, p - k - 2), p + 1)) AS u(a)
       WHERE list_has_all(d.w[a : a + k + 2], bt.ws)),
nt AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM nr GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(nt.n, 0)::BIGINT AS n_near, sha256(coalesce(nt.s, '')) AS near_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nt USING (doc_id)
"""
