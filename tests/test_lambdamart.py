"""LambdaMART against a plain version, and what it learns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from cargolore.operators import lambdamart as lm


def table(seed, queries, size=12):
    r = random.Random(seed)
    rows = []
    for q in range(queries):
        for _ in range(r.randrange(2, size)):
            a, b, c = r.randrange(10) / 10, r.randrange(10) / 10, r.random()
            # not a sum of the features: a matters only where b is high
            grade = min(4, int(3 * a * (b > 0.5) + 2 * (b < 0.2) + 0.3 * r.random()))
            rows.append((q, grade, a, b, c))
    return rows


SCHEMA = "query_id long, grade int, a double, b double, c double"


def plain_gradients(grades, scores, truncation):
    order = sorted(range(len(grades)), key=lambda i: -scores[i])
    place = {row: i for i, row in enumerate(order)}
    disc = lambda i: 1 / np.log2(i + 2) if i < truncation else 0.0
    total = sum((2**g - 1) * disc(i) for i, g in enumerate(sorted(grades, reverse=True)))
    g, h = [0.0] * len(grades), [0.0] * len(grades)
    for x in range(len(grades)):
        for y in range(len(grades)):
            if grades[x] > grades[y] and min(place[x], place[y]) < truncation:
                delta = (2 ** grades[x] - 2 ** grades[y]) * abs(disc(place[x]) - disc(place[y])) / total
                p = 1 / (1 + np.exp(scores[x] - scores[y]))
                g[x] -= delta * p
                g[y] += delta * p
                h[x] += delta * p * (1 - p)
                h[y] += delta * p * (1 - p)
    return g, h


@pytest.mark.parametrize("seed", range(20))
def test_gradients(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 12))
    grades, scores = r.integers(0, 4, n), np.round(r.normal(size=n), 1)
    g, h = lm.gradients(grades.astype(float), scores, 4)
    pg, ph = plain_gradients(grades.tolist(), scores.tolist(), 4) if grades.any() else ([0.0] * n, [0.0] * n)
    assert np.allclose(g / lm.UNIT, pg, atol=1e-8 * n) and np.allclose(h / lm.UNIT, ph, atol=1e-8 * n)


def plain_tree(rows, bins, g, h, leaves, rate, min_rows):
    """Leaf by leaf on all rows in memory: (rows, value) of each leaf."""
    parts = [(np.arange(len(rows)), 0)]
    number = 1

    def best(own):
        out = None
        for f in range(bins.shape[1]):
            for cut in range(int(bins.max())):
                side = bins[own, f] <= cut
                left, right = own[side], own[~side]
                if min(len(left), len(right)) < min_rows or not h[left].sum() or not h[right].sum():
                    continue
                fit = lambda x: (g[x].sum() / lm.UNIT) ** 2 / (h[x].sum() / lm.UNIT)
                gain = round(fit(left) + fit(right) - fit(own), 12)
                if gain > 1e-9 and (out is None or gain > out[0]):
                    out = (gain, left, right)
        return out

    found = [(best(parts[0][0]), parts[0][0], 0)]
    while len(found) < leaves and any(b for b, _, _ in found):
        k = max((i for i in range(len(found)) if found[i][0]), key=lambda i: (found[i][0][0], -found[i][2]))
        (_, left, right), _, _ = found.pop(k)
        found += [(best(left), left, number), (best(right), right, number + 1)]
        number += 2
    value = np.zeros(len(rows))
    for _, own, _ in found:
        value[own] = -rate * g[own].sum() / h[own].sum()
    return value


def test_trees_against_a_plain_version(spark):
    rows = table(1, 25)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    model = lm.fit(df, ["a", "b", "c"], rounds=4, leaves=6, rate=0.3, bins=15, held_out=0)
    x = np.array([r[2:] for r in rows])
    bins = lm.bin_rows(x, model.edges)
    score = np.zeros(len(rows))
    for tree in model.trees:
        g, h = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for q in {r[0] for r in rows}:
            own = np.array(sorted((i for i, r in enumerate(rows) if r[0] == q), key=lambda i: (rows[i][2:], rows[i][1])))
            g[own], h[own] = lm.gradients(np.array([rows[i][1] for i in own], float), score[own], lm.TRUNCATION)
        value = plain_tree(rows, bins, g, h, 6, 0.3, lm.MIN_ROWS)
        assert np.allclose(tree.scores(bins), value, atol=1e-12)
        score += value
    assert len(model.trees) == 4
    got = {tuple(r[:5]): r.s for r in df.withColumn("s", model.column()).collect()}
    assert all(abs(got[r] - s) < 1e-9 for r, s in zip(rows, score, strict=True))


def test_beats_linear_weights_on_held_out_queries(spark):
    train, other = (spark.createDataFrame(table(s, n), SCHEMA) for s, n in ((2, 150), (3, 80)))
    model = lm.fit(train, ["a", "b", "c"], rounds=25, rate=0.2, leaves=8, patience=10)

    def at3(score):
        from cargolore.operators.retrieval import rank

        placed = rank(other.withColumn("s", score), [F.desc("s"), F.asc("a"), F.asc("c")], name="place")
        return {r.k: r.ndcg for r in lm.ndcg_of(placed).collect()}[3]

    linear = max(at3(w * F.col("a") + (1 - w) * F.col("b")) for w in (0.0, 0.3, 0.5, 0.7, 1.0))
    assert at3(model.column()) > linear + 0.03
    assert model.history[-1]["ndcg3"] > model.history[0]["ndcg3"]


def test_odd_tables(spark):
    none = lm.fit(spark.createDataFrame([], SCHEMA), ["a", "b"], rounds=3)
    assert none.trees == [] and none.history[0]["ndcg1"] is None
    equal = spark.createDataFrame([(1, 2, 0.1, None, 1.0), (1, 2, 0.2, 0.5, 1.0), (None, 3, 0.2, 0.5, 1.0), (2, None, None, None, None)], SCHEMA)
    model = lm.fit(equal, ["a", "b"], rounds=3, held_out=0)
    assert model.trees == [] and {r.s for r in equal.withColumn("s", model.column()).collect()} == {0.0}


def test_ndcg():
    grades, scores = np.array([0.0, 3.0, 1.0]), np.array([2.0, 1.0, 3.0])
    want = (1 + 0 + 7 / 2) / (7 + 1 / np.log2(3))
    assert abs(lm.ndcg(grades, scores, 3) - want) < 1e-12
    assert lm.ndcg(np.zeros(3), scores, 3) is None


def test_lists_of_one_length_are_one_matrix(spark, monkeypatch):
    """As list by list, to the last unit; a task calls for each length, not for each list."""
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        grades, scores = r.integers(0, 5, (30, n)).astype(float), np.round(r.normal(size=(30, n)), 1)
        grades[0] = 0
        g, h = lm.gradients_of(grades, scores, 4)
        for i in range(30):
            pg, ph = plain_gradients(grades[i], scores[i], 4) if grades[i].any() else (np.zeros(n), np.zeros(n))
            assert np.allclose(g[i] / lm.UNIT, pg, atol=1e-8 * n) and np.allclose(h[i] / lm.UNIT, ph, atol=1e-8 * n)
            one, many = lm.ndcg(grades[i], scores[i], 3), lm.ndcg_of_lists(grades[i : i + 1], scores[i : i + 1], 3)[0]
            assert np.isnan(many) if one is None else abs(one - many) < 1e-12
    calls = spark.sparkContext.accumulator(0)
    found = lm.gradients_of
    monkeypatch.setattr(lm, "gradients_of", lambda *x: (calls.add(1), found(*x))[1])
    rows = spark.range(400).selectExpr("id DIV 4 AS query_id", "CAST(id % 3 AS INT) AS grade", "CAST(id % 5 AS DOUBLE) AS a").coalesce(1)
    lists = lm.lists_of(rows, ["a"], [[0.0, 1.0, 2.0, 3.0]], "query_id", "grade", 0)
    state = lm._advanced(lists.coalesce(1), [], 1, lm.TRUNCATION).collect()
    assert len(state) == 100 and calls.value == 1


def test_a_round_is_one_job_where_bins_are_few(spark, monkeypatch):
    """The same trees, scores and NDCG as with a score for each row, and no job for a level of a tree."""
    rows = spark.createDataFrame([(q, g * (q % 3 > 0), a, b, None) for q, g, a, b, _ in table(4, 120)] + [(900, 2, 0.5, 0.5, None), (901, 2, 0.1, 0.9, None)], SCHEMA).repartition(3)
    fitted = lambda held: lm.fit(rows, ["a", "b", "c"], rounds=30, leaves=6, rate=0.3, bins=9, held_out=held, patience=5)
    counted, plain = [], lm.histograms
    monkeypatch.setattr(lm, "histograms", lambda *x: (counted.append(1), plain(*x))[1])
    for held in (0, 4):
        got = fitted(held)
        assert not counted and got.trees
        with monkeypatch.context() as patch:
            patch.setattr(lm, "CELLS", 3)
            want = fitted(held)
        assert counted and got.trees == want.trees
        assert np.allclose([list(x.values()) for x in got.history], [list(x.values()) for x in want.history], atol=1e-8)
        counted.clear()
        one, two = ([r.s for r in rows.select(m.column().alias("s")).collect()] for m in (got, want))
        assert np.allclose(one, two, atol=1e-12)


def test_registered_ranker_is_trained_whole(spark, monkeypatch):
    asked = []

    class Stop(Exception):
        pass

    def fit(rows, features, **named):
        asked.append(named)
        raise Stop

    monkeypatch.setattr(lm, "fit", fit)
    with pytest.raises(Stop):
        contract.queries()["ltr_lambdamart"](spark, "/root/testdata/sf0.001")
    assert asked == [{}]  # neither rounds nor rows are cut
