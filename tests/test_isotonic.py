"""Isotonic fits by pooled ranges against a plain version."""

import random

import pytest

from cargolore.operators.evaluation import isotonic


def plain(rows):
    by_score = {}
    for s, c in rows:
        if s is not None and c is not None:
            y, n = by_score.get(s, (0, 0))
            by_score[s] = (y + c, n + 1)
    blocks = []
    for s in sorted(by_score):
        blocks.append([[s], *by_score[s]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            scores, y, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + scores, blocks[-1][1] + y, blocks[-1][2] + n]
    return {s: y / n for scores, y, n in blocks for s in scores}


@pytest.mark.parametrize(("n", "digits"), [(100_000, 3), (20_000, 9), (50, 1), (1, 1)])
def test_fit(spark, n, digits):
    r = random.Random(n)
    rows = [(s := round(r.random(), digits), r.random() < s * s) for _ in range(n)] + [(None, True), (0.5, None)]
    got = isotonic(spark.createDataFrame(rows, "score double, correct boolean").repartition(4))
    want = plain(rows)
    found = got.collect()
    assert len(found) == len(rows)
    assert all((f.probability is None) == (f.score is None or f.correct is None) for f in found)
    assert all(f.probability == pytest.approx(want[f.score]) for f in found if f.probability is not None)


def test_monotone_and_empty(spark):
    rising = [(i / 100, i >= 50) for i in range(100)]
    assert {r.score: r.probability for r in isotonic(spark.createDataFrame(rising, "score double, correct boolean")).collect()} == plain(rising)
    assert isotonic(spark.createDataFrame([], "score double, correct boolean")).count() == 0
