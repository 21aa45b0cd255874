"""N-gram Jaccard self-join with Bayesian candidate pruning.

A document's set is its shingles of ``words`` consecutive words (A-Z
lower-cased; words are runs of 0-9, a-z and non-ASCII characters; a document of
fewer words, but not none, is one shingle).  Documents with equal word
sequences are compared once and counted with their number.

1. *Bands.*  MinHash values, one byte each, in bands; documents that share a band's
   values are in one bucket.  Buckets are cut into blocks, and pairs of blocks are
   tasks' groups, so a hot bucket is spread over many tasks.  Two documents meet in
   the first band that they share only.
2. *Pruning.*  Pairs in a bucket are compared by a few MinHash values at a time.  With
   a uniform prior, after ``n`` values of which ``m`` agree the similarity has the
   posterior Beta(m+1, n-m+1); a pair is dropped as soon as the probability of at
   least the threshold is below ``tolerance``.  (One byte agrees by chance now and
   then, which only keeps pairs in.)  A group gives back a tree of its pairs that
   are left, an edge a document.
3. *Verification.*  Documents that pruned pairs connect are a cluster.  Only now are
   their shingle sets made; clusters are cut into blocks by size, and in each pair of
   blocks what pruning leaves is verified exactly on the whole sets.  No bucket,
   cluster or number of partners is capped.

At the threshold a pair shares a band with probability ``1 - (1 - t^r)^b``,
0.99995 for 25 bands of 5 at 0.8, and more above it.

Clusters hold what is likely to be at least about 0.63 similar by estimate, so a chain of documents that
resemble their neighbours is one cluster, all pairs of which are compared by
MinHash values; that takes the square of the chain's length.

Defined cases: null or empty texts have no shingles, link with nothing and are
kept; rows with a null id likewise; rows with equal ids are one document that
holds all their texts; a text of any length is one set of all its shingles.  An
empty table gives no rows.  Columns other than ``doc_id`` and ``text`` are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolore.llm.common import Words, chunks, grams, hot_join, materialize, mix, text_buffer
from cargolore.llm.components import components
from cargolore.llm.embedding_dedup import roots

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
#: MinHash values that a round of pruning adds, and all of them.
ROUND = 25
HASHES = BANDS * ROWS
TOLERANCE = 1e-6
#: A block of a cluster has at most about so many documents, and so many shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1_000_000
#: A block of a bucket has at most about so many documents.
BUCKET_DOCS = 1024
SEED = 8


def minhash(values: np.ndarray, counts: np.ndarray, hashes: int = HASHES, seed: int = SEED) -> np.ndarray:
    """MinHash values of sets that lie one after the other, none of them empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**32, hashes, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, hashes, dtype=np.uint64).astype(np.uint32)
    out = np.empty((len(counts), hashes), np.uint32)
    starts = np.cumsum(counts) - counts
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    for i in range(hashes):
        x = (low * a[i] + b[i]) ^ high
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(x, starts)
    return out


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' shingle hashes, in order, and how many each has."""
    counts = np.where(words.counts >= k, words.counts - k + 1, np.minimum(words.counts, 1))
    ends = np.cumsum(words.counts)
    begin = ends - words.counts
    runs = grams(words.hashes, k)
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    short = np.repeat((words.counts < k) & (words.counts > 0), counts)
    out = runs[np.minimum(at, max(len(runs) - 1, 0))] if len(runs) else np.zeros(len(at), np.uint64)
    for i in np.flatnonzero(short):  # rare: a text of under k words
        first = at[i]
        size = words.counts[np.searchsorted(ends, first, side="right")]
        out[i] = grams(words.hashes[first : first + size], int(size))[0] + np.uint64(size)
    return out, counts


def least_agreements(threshold: float, tolerance: float, hashes: int, step: int) -> list[int]:
    """After each round, the agreements that a pair needs to stay a candidate.

    P(J >= t) under Beta(m+1, n-m+1) is the probability that a Binomial(n+1, t)
    is at most m.
    """
    out = []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, 0
        for m in range(n + 2):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return out


def candidates(sign: np.ndarray, a: np.ndarray, b: np.ndarray, need: list[int], step: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows ``a`` x ``b`` of MinHash values that every round has left."""
    agree = np.zeros((len(a), len(b)), np.int16)
    for k in range(step):
        agree += sign[a, k][:, None] == sign[b, k][None, :]
    i, j = np.nonzero(agree >= need[0])
    agree = agree[i, j].astype(np.int64)
    for r in range(1, len(need)):
        part = slice(r * step, (r + 1) * step)
        agree += (sign[a[i], part] == sign[b[j], part]).sum(1)
        keep = agree >= need[r]
        i, j, agree = i[keep], j[keep], agree[keep]
    return a[i], b[j]


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of ``sets[i]`` and ``sets[j]``."""
    if len(i) <= 4:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    rows, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    _, column, freq = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    shared = freq[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(rows), len(rows)), np.float64)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, [low, low + width])
        if x < y:
            part = np.zeros((len(rows), width), np.float32)
            part[row[x:y], column[x:y] - low] = 1
            both += part @ part.T
    return both[place[: len(i)], place[len(i) :]].astype(np.int64)


def _signatures(k: int, hashes: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffer(batch.column("text"))
            for first, last in chunks(ends):
                base = ends[first - 1] if first else 0
                words = Words(data[base : ends[last - 1]], ends[first:last] - base, "folded")
                some = np.flatnonzero(words.counts)
                if not len(some):
                    continue
                values, counts = shingle_sets(words, k)
                sign = low_bytes(minhash(values, counts[some], hashes))
                # the word sequence, as two polynomial values of the word hashes
                begin = (np.cumsum(words.counts) - words.counts)[some]
                place = np.arange(len(words.hashes), dtype=np.uint64) - np.repeat(begin, words.counts[some]).astype(np.uint64)
                one = mix(np.add.reduceat(words.hashes * mix(place + np.uint64(1)), begin) + words.counts[some].astype(np.uint64))
                two = np.add.reduceat(mix(words.hashes ^ mix(place + np.uint64(0x51ED))), begin)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(first, last - first).take(pa.array(some)),
                    "h1": pa.array(one.view(np.int64)), "h2": pa.array(two.view(np.int64)), "size": pa.array(counts[some].astype(np.int64)),
                    "sign": pa.array([x.tobytes() for x in sign], pa.binary()),
                })

    return run


def low_bytes(sign: np.ndarray) -> np.ndarray:
    """One byte of each MinHash value, well mixed."""
    return ((sign * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)


def _rows_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _prune(threshold: float, tolerance: float, band_rows: int, hashes: int):  # noqa: ANN202
    """A tree of the pairs of a bucket's two blocks that pruning leaves."""
    need = least_agreements(threshold, tolerance, hashes, min(ROUND, hashes))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        ids, block, sign = table["rep"].to_numpy(), table["block"].to_numpy(), _rows_of(table["sign"])
        low, high, band = (int(table[n][0].as_py()) for n in ("low", "high", "band"))
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        left, right = [], []
        for k in range(0, len(a), 256):
            i, j = candidates(sign, a[k : k + 256], b, need, min(ROUND, hashes))
            keep = (ids[i] < ids[j]) if low == high else (ids[i] != ids[j])
            i, j = i[keep], j[keep]
            for earlier in range(band):
                part = slice(earlier * band_rows, (earlier + 1) * band_rows)
                keep = (sign[i, part] != sign[j, part]).any(axis=1)
                i, j = i[keep], j[keep]
            # a tree of these pairs says as much as they do
            root = roots(len(ids), i, j)
            some = np.flatnonzero(root != np.arange(len(ids)))
            left.append(some)
            right.append(root[some])
        if not left:
            return pa.table({"u": ids[:0], "v": ids[:0]})
        root = roots(len(ids), np.concatenate(left), np.concatenate(right))
        some = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"u": ids[some], "v": ids[root[some]]})

    return run


def _sets(k: int, hashes: int):  # noqa: ANN202
    """Each text's set of shingles and MinHash values; texts without words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = ("rep", "copies", "cluster", "blocks", "pack")
        for batch in batches:
            data, ends = text_buffer(batch.column("text"))
            for first, last in chunks(ends):
                base = ends[first - 1] if first else 0
                words = Words(data[base : ends[last - 1]], ends[first:last] - base, "folded")
                some = np.flatnonzero(words.counts)
                if not len(some):
                    continue
                values, counts = shingle_sets(words, k)
                counts = counts[some]
                stops = np.cumsum(counts)
                sets = [np.unique(values[e - c : e]).tobytes() for e, c in zip(stops, counts, strict=True)]
                sign = [x.tobytes() for x in low_bytes(minhash(values, counts, hashes))]
                part = batch.slice(first, last - first).take(pa.array(some))
                yield pa.RecordBatch.from_pydict({n: part.column(n) for n in keep} | {"sign": pa.array(sign, pa.binary()), "grams": pa.array(sets, pa.binary())})

    return run


def _verify(threshold: float, tolerance: float, hashes: int):  # noqa: ANN202
    need = least_agreements(threshold, tolerance, hashes, min(ROUND, hashes))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("rep", "ascending")])
        ids, clusters = table["rep"].to_numpy(), table["cluster"].to_numpy()
        copies, block = table["copies"].to_numpy(), table["block"].to_numpy()
        low, high = int(table["low"][0].as_py()), int(table["high"][0].as_py())
        sets = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
        size = np.array([len(s) for s in sets])
        links = np.zeros(len(ids), np.int64)
        left, right = [], []
        own = np.unique(ids, return_index=True)[1][np.unique(ids, return_inverse=True)[1]]
        sign = _rows_of(table["sign"])
        edge = np.flatnonzero(np.append(True, clusters[1:] != clusters[:-1]))
        for start, stop in zip(edge, np.append(edge[1:], len(ids)), strict=True):
            rows = np.arange(start, stop)
            a, b = rows[block[rows] == low], rows[block[rows] == high]
            i, j = candidates(sign, a, b, need, min(ROUND, hashes))
            keep = (i < j) if low == high else np.ones(len(i), bool)
            keep &= ids[i] != ids[j]
            i, j = i[keep], j[keep]
            if len(i):
                common = overlaps(sets, i, j)
                keep = common >= threshold * (size[i] + size[j] - common) - 1e-9
                i, j = i[keep], j[keep]
                # a document's rows (repeated, or several texts) are linked as one
                pairs = np.unique(np.stack([np.minimum(own[i], own[j]), np.maximum(own[i], own[j])]), axis=1)
                np.add.at(links, pairs[0], copies[pairs[1]])
                np.add.at(links, pairs[1], copies[pairs[0]])
                left.append(pairs[0])
                right.append(pairs[1])
        some = np.flatnonzero(links)
        root = roots(len(ids), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(ids))
        return pa.table({"rep": ids[some], "n": links[some], "root": ids[root][some]})

    return run


def jaccard_join(docs: DataFrame, *, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = ROWS, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, class_id, n_links, kept``, one row for each row of ``docs``.

    ``class_id`` is the smallest id of the document's class (the component of
    the links), ``n_links`` the number of other documents at least ``threshold``
    similar, ``kept`` whether the document stands for its class.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known, hashes = own.where("doc_id IS NOT NULL"), bands * band_rows
    signed = materialize(known.mapInArrow(_signatures(words, hashes), "doc_id bigint, h1 bigint, h2 bigint, size bigint, sign binary"), "signatures")
    texts = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.max("size").alias("size"), F.count("*").alias("n"), F.first("sign").alias("sign"))
    texts = materialize(texts, "texts")
    member = hot_join(signed.select("doc_id", "h1", "h2"), texts.select("h1", "h2", "rep", "copies", "n"), ["h1", "h2"], "n", F.xxhash64("doc_id"))
    member = member.select("doc_id", "rep", "copies")

    cut = F.array(*(F.substring("sign", b * band_rows + 1, band_rows) for b in range(bands)))
    # signatures go only to the rows of a band that share its bucket, by the text's key
    banded = texts.select("h1", "h2", "rep", F.posexplode(cut).alias("band", "bucket"))
    sizes = banded.groupBy("band", "bucket").agg(F.count("*").alias("m"), F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    sizes = materialize(sizes.select("band", "bucket", "m", F.ceil(F.col("m") / BUCKET_DOCS).cast("int").alias("blocks")), "buckets")
    met = hot_join(banded, sizes, ["band", "bucket"], "m", F.xxhash64("rep"))
    met = met.join(texts.select("h1", "h2", "sign").hint("shuffle_merge"), ["h1", "h2"])
    met = met.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    met = met.select("band", "bucket", "rep", "sign", "block", F.least("block", "o").cast("int").alias("low"), F.greatest("block", "o").cast("int").alias("high"))
    left = met.groupBy("band", "bucket", "low", "high").applyInArrow(_prune(threshold, tolerance, band_rows, hashes), "u bigint, v bigint")
    near = components(left)

    held = texts.groupBy("rep").agg(F.max("copies").alias("copies"), F.sum("size").alias("size"))
    near = materialize(near.join(held, near["node"] == F.col("rep")).select("rep", "copies", "size", F.col("component").alias("cluster")), "candidates")
    total = near.agg(F.sum("size")).first()[0] or 0
    packs = max(1, math.ceil(total / BLOCK_SHINGLES * 4))
    sized = near.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("m"))
    # clusters of one block are packed together by hash, others stand alone
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(packs))).otherwise(-1 - F.col("cluster"))
    placed = hot_join(near, materialize(sized, "clusters"), ["cluster"], "m", F.xxhash64("rep"))
    placed = placed.select("rep", "copies", "cluster", "blocks", pack.cast("long").alias("pack"))
    # always by sort-merge: the plan is the same at every size
    with_text = known.join(placed.hint("shuffle_merge"), known["doc_id"] == placed["rep"]).select("rep", "copies", "cluster", "blocks", "pack", "text")
    sets = with_text.mapInArrow(_sets(words, hashes), "rep bigint, copies bigint, cluster bigint, blocks int, pack bigint, sign binary, grams binary")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = sets.withColumn("block", block).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    pairs = pairs.select("rep", "copies", "cluster", "pack", "block", "sign", "grams", F.least("block", "o").cast("int").alias("low"), F.greatest("block", "o").cast("int").alias("high"))
    found = materialize(pairs.groupBy("pack", "low", "high").applyInArrow(_verify(threshold, tolerance, hashes), "rep bigint, n bigint, root bigint"), "links")

    # documents with several texts tie the texts' classes together
    tied = member.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).unionByName(tied))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    linked = member.join(counts, "rep", "left").groupBy("doc_id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = linked.join(groups, linked["doc_id"] == groups["node"], "left").select("doc_id", "n_links", "component")
    out = own.select("doc_id").join(linked, "doc_id", "left")
    class_id = F.coalesce("component", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: a row for every document."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT d.doc_id, c.c AS class_id, coalesce(k.n, 0)::BIGINT AS n_links, c.c = d.doc_id AS kept
FROM documents AS d JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
