"""Hard negatives against all pairs, over many small lists, with odd rows."""

import math

import numpy as np
import pytest

from docforge.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, RANK int, ask string"


def brute(rows, low=80, high=100):
    own = []
    for r, (i, v, label, *_) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((r, i, (label + 1) % 10 if i % 7 == 0 else label, np.array([math.floor(256 * float(np.float32(x))) for x in v], object)))
    out = []
    for r, i, label, x in own:
        if i % 100:
            continue
        scored = sorted((-int((x * y).sum()), j, s, m) for s, j, m, y in own if s != r and len(y) == len(x))
        for p, j, _, _ in [t for t in scored if t[3] == label][:5]:
            fit = [t for t in scored if t[3] != label and low * -p <= 100 * -t[0] <= high * -p][:5]
            out += [(i, j, k + 1, t[1], -p, -t[0]) for k, t in enumerate(fit)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3, "vec_id")


def mined(df, **more):
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("spread", [0.2, 2.0])
def test_all_pairs(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + spread * rng.normal(size=8)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(1200)]
    got = mined(table(spark, rows), list_rows=40, block_rows=3, learn_rows=400)
    assert got == brute(rows) and got


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    vector = lambda n=4: rng.normal(size=n).astype(np.float32).tolist()
    same = vector()
    rows = [(i, same, i % 2) for i in range(1, 40)] + [(100, same, 0), (100, same, 0), (-100, vector(), 1), (0, [0.0] * 4, 1)]
    rows += [(200, vector(3), 1), (201, vector(3), 1), (202, vector(3), 2), (300, vector(5), 1), (None, same, 1), (400, None, 1), (500, same, None), (600, [], 1)]
    rows += [(700, [1.0, None, 1.0, 1.0], 1), (800, [1.0, float("nan"), 1.0, 1.0], 1), (900, [1.0, float("inf"), 1.0, 1.0], 1)]
    assert mined(table(spark, rows), list_rows=8) == brute(rows)
    assert mined(table(spark, rows[:0])) == []
    large = [(100, [5e6, 1.0], 1), (1, [5e6, 2.0], 1), (2, [4.5e6, 1.0], 2), (200, [1e30, 1.0], 1)]  # exact beyond 2^53; too large for any long
    assert mined(table(spark, large)) == brute(large[:3]) and mined(table(spark, large))
