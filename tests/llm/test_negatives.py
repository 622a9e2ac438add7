"""Hard negatives against brute force; the bounds against the scores they bound."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score double, block long"


def brute(rows, positives=5, bests=3):
    whole = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole[i, tuple(math.floor(float(np.float32(x)) * 256) for x in v), label] = None
    whole = [*whole]

    def score(a, b):
        return sum(x * y for x, y in zip(a[1], b[1]))

    out = []
    for a in whole:
        if a[0] % 50:
            continue
        same = sorted((-score(a, b), b[0]) for b in whole if b != a and b[2] == a[2])[:positives]
        for s, p in same:
            found = sorted((-score(a, b), b[0]) for b in whole if b[2] != a[2] and 50 * -s <= 100 * score(a, b) <= 95 * -s)[:bests]
            out += [(a[0], p, r, i, -s, -t) for r, (t, i) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.mine(frame, F.col("vec_id") % 50 == 0, **options).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clusters(seed, n, dims=8, labels=4, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels * 2, dims))
    own = rng.integers(0, labels * 2, n)
    v = (centres[own] + spread * rng.normal(size=(n, dims))) * rng.choice([0.2, 1.0, 1.5], (n, 1))
    return [(i, [float(x) for x in v[i]], int(own[i] % labels)) for i in range(n)]


@pytest.mark.parametrize("seed,spread", [(1, 0.4), (2, 0.02), (3, 3.0)])
def test_against_brute_force(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(negatives, "VECTORS", 32)  # many blocks, so that the passes and the cuts matter
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rows = clusters(seed, 700, spread=spread)
    assert mined(spark, rows) == brute(rows)


def test_unfit_equal_and_repeated_rows(spark):
    rows = clusters(5, 120, dims=4)
    rows += [(200, None, 1), (250, [1.0, None, 0.0, 0.0], 1), (300, [1.0, math.nan, 0.0, 0.0], 1), (350, [math.inf, 0.0, 0.0, 0.0], 1),
             (400, [1.0, 0.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0, 0.0], 1), (450, [0.0] * 4, 1), (500, [1.0, 2.0], 2), (550, [], 2)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5], 1) for i in range(40)] + [(2000 + i, [0.4, 0.4, 0.4, 0.4], 2) for i in range(40)]
    rows += rows[:30] + [(0, rows[3][1], 1), (50, rows[50][1], (rows[50][2] + 1) % 4)]
    assert mined(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.99], 2)]) == [(0, 1, 1, 2, 65536, 58880)]
    # a score of 0 has a window of 0 alone, a negative one none
    assert mined(spark, [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 3.0], 2), (3, [-1.0, 0.0], 1)]) == [(0, 1, 1, 2, 0, 0)]


def test_large_components_are_exact(spark):
    rows = [(i, [float(2 ** 22 + 37 * i), float(3 * i), float(2 ** 21 - i)], i % 3) for i in range(120)]
    assert mined(spark, rows) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(9)
    for dims in (1, 2, 3, 16):
        a, b = rng.integers(-300, 300, (40, dims)), rng.integers(-300, 300, (60, dims))
        b[:20] = a[:20] * rng.integers(-2, 3, (20, 1))  # parallel, opposite and zero
        directions = negatives.fit_directions(b, 5)
        parts = [(*negatives._units(x),) for x in (a, b)]
        (ua, na), (ub, nb) = parts
        aa, ab = negatives._angles(ua, directions), negatives._angles(ub, directions)
        low, high = negatives.score_bounds(aa, na, ab, nb, dims)
        score = a @ b.T
        assert (low <= score).all() and (score <= high).all()
        rng_a = np.stack([aa.min(axis=0), aa.max(axis=0)], axis=1)
        rng_b = np.stack([ab.min(axis=0), ab.max(axis=0)], axis=1)[None]
        low, high = negatives.block_bounds(rng_a, np.array([na.min(), na.max()]), rng_b, np.array([[nb.min(), nb.max()]]), dims)
        assert low[0] <= score.min() and score.max() <= high[0]


def test_the_filter_leaves_out_pairs():
    rows = np.array([r[1] for r in clusters(7, 2000, spread=0.05)]) * 256
    directions = negatives.fit_directions(rows)
    units, norms = negatives._units(rows)
    angles = negatives._angles(units, directions)
    low, high = negatives.score_bounds(angles[:50], norms[:50], angles, norms, rows.shape[1])
    best = np.sort(rows[:50] @ rows.T, axis=1)[:, -6]
    assert (high >= best[:, None]).mean() < 0.3
