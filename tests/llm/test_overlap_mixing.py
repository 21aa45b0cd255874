"""Overlapping sources: the flow over membership patterns against successive
cheapest paths, on the whole test table and on odd rows."""

import collections

import pytest
from pyspark.sql import functions as F

from cargolore.llm import mixing

FOLDER = "/root/testdata/sf0.001"


def cheapest_flow(patterns, quotas, limit):
    """Most words and their least cost, one cheapest path (Bellman-Ford) after another."""
    arcs, out = [], collections.defaultdict(list)

    def arc(a, b, room, cost):
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([x, y, r, c])

    for i, (n, sources) in enumerate(patterns):
        for copy in range(limit):
            arc("from", ("p", i), n, copy)
        for s in sources:
            arc(("p", i), ("s", s), limit * n, 0)
    for s, q in quotas.items():
        arc(("s", s), "to", q, 0)
    total = cost = 0
    while True:
        far, by = {"from": 0}, {}
        waiting = collections.deque(["from"])
        while waiting:
            x = waiting.popleft()
            for e in out[x]:
                _, y, room, c = arcs[e]
                if room and far[x] + c < far.get(y, 10**9):
                    far[y], by[y] = far[x] + c, e
                    waiting.append(y)
        if "to" not in far:
            return total, cost
        path, y = [], "to"
        while y != "from":
            path.append(by[y])
            y = arcs[by[y]][0]
        push = min(arcs[e][2] for e in path)
        for e in path:
            arcs[e][2] -= push
            arcs[e ^ 1][2] += push
        total, cost = total + push, cost + push * far["to"]


def checked(sized):
    """The mix of ``sized`` (``doc_id, n, sources``), held against the flow above."""
    got = mixing.mix(sized, "sources", size=F.col("n")).collect()
    sizes, longest, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for r in got:
        key = tuple(r.pattern)
        sizes[key] += r["size"]
        longest[key] = max(longest[key], r["size"])
        taken[key] += r.taken
        assert r.taken == r.repeats * r["size"] <= 3 * r["size"]
    own = [k for k in sorted(sizes) if k]
    totals = sized.sparkSession.createDataFrame([(list(k), sizes[k], i) for i, k in enumerate(own)], "pattern array<string>, n long, pno long")
    known = mixing.source_targets(totals).collect()
    quotas = {r.source: round(r.target) for r in known}
    words = {r.pno: r.words for r in mixing.pattern_words(totals, mixing.source_targets(totals)).collect()}
    cost = 0
    for i, k in enumerate(own):
        n, w = sizes[k], words[i]
        assert w <= 3 * n and abs(taken[k] - w) <= longest[k]
        rounds, rest = divmod(w, n) if n else (0, 0)
        cost += sum(c * n for c in range(rounds)) + rest * rounds
    assert (sum(words.values()), cost) == cheapest_flow([(sizes[k], k) for k in own], quotas, 3)
    return got, quotas, sizes


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got, quotas, sizes = checked(mixing.memberships(docs))
    assert len(got) == docs.count() and len(quotas) > 2 and any(len(k) == 2 for k in sizes)
    # each source and each language gets its target if the flow can be whole
    again = mixing.overlap_query(spark, FOLDER).select("doc_id", "size", "taken").collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter((r.doc_id, r["size"], r.taken) for r in got)


def test_reruns_agree(spark):
    """Patterns are numbered as they arrive, the flow does not depend on it."""
    sized = mixing.memberships(spark.read.parquet(f"{FOLDER}/documents.parquet")).cache()
    each = [
        collections.Counter((r.doc_id, r.taken) for r in mixing.mix(df, "sources", size=F.col("n")).collect())
        for df in (sized, sized.repartition(7).orderBy(F.desc("doc_id")), sized.repartition(3, F.xxhash64("doc_id")))
    ]
    assert each[0] == each[1] == each[2]


def test_odd_rows(spark):
    rows = [
        (1, 40, ["a", "b"]), (2, 0, ["a"]), (3, 7, ["b", "a", "b"]), (None, 7, ["a", "b"]), (3, 7, ["b", "a"]), (4, 90, ["c"]), (5, 1, ["c", "d"]), (6, 3, []), (7, 3, None), (8, 100_000, ["d"]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, n long, sources array<string>")
    got, _, _ = checked(df)
    assert len(got) == len(rows) and {r.taken for r in got if r.doc_id in (6, 7)} == {0}
    assert mixing.mix(df.limit(0), "sources", size=F.col("n")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_patterns(spark, seed):
    pick = lambda i, k: (i * 7919 * seed + k * 104729) % 101
    rows = [(i, pick(i, 1), sorted({f"s{pick(i, 2) % 6}", f"s{pick(i, 3) % 9}"})) for i in range(300)]
    checked(spark.createDataFrame(rows, "doc_id long, n long, sources array<string>"))
