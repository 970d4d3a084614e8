"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapecode.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, digest string, dim int, salt long, place int"      # clashing names


def frame(spark, rows):
    return spark.createDataFrame([(i, e, k, "d", 1, 2, 3) for i, e, k in rows], SCHEMA).repartition(3)


def brute(rows, every=10, positives=5, negatives=5):
    clean = {}
    for i, e, k in rows:
        if i is None or k is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        x = tuple(math.floor(256 * float(np.float32(v))) for v in e)
        clean[i, (k + 1) % 10 if i % 7 == 0 else k, x] = None
    clean, out = list(clean), []
    for a in clean:
        if a[0] % every:
            continue
        score = lambda b: max(-2**63, min(2**63 - 1, sum(p * q for p, q in zip(a[2], b[2]))))
        order = sorted(((-score(b), b[0], b) for b in clean if b != a and len(b[2]) == len(a[2])), key=lambda t: t[:2])
        for s, pid, p in [t for t in order if t[2][1] == a[1]][:positives]:
            near = [t for t in order if t[2][1] != a[1] and 80 * -s <= 100 * -t[0] <= 100 * -s][:negatives]
            out += [(a[0], pid, r + 1, t[1], -s, -t[0]) for r, t in enumerate(near)]
    return sorted(out)


def mined(spark, rows, every=10, **size):
    k = F.col("label")
    df = H.mine(frame(spark, rows), is_anchor=F.col("vec_id") % every == 0, relabel=F.when(F.col("vec_id") % 7 == 0, (k + 1) % 10).otherwise(k), **size)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def vectors(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((4, dim))
    x = centre[rng.integers(0, 4, n)] + 0.4 * rng.standard_normal((n, dim))
    return [(i, [round(float(v), 1) for v in r], int(rng.integers(0, 5))) for i, r in enumerate(x)]


@pytest.mark.parametrize("size", [{}, {"block": 20, "anchors_in_group": 8}])
def test_negatives_equal_brute_force(spark, size):
    rows = vectors(1, 300)
    rows += [(1000, None, 1), (1010, [1.0] * 6, None), (1020, [float("nan")] + [1.0] * 5, 1), (1030, [float("inf")] * 6, 2), (1040, [None] + [1.0] * 5, 1),
             (1050, [0.0] * 6, 3), (1060, [], 1), (1061, [], 1), (1062, [], 2), (None, [1.0] * 6, 1), (1070, [1.0, 2.0], 4), (1071, [2.0, 2.0], 4),
             (1072, [2.0, 1.9], 5), rows[20], rows[21], (2000, [-1.0] * 6, 3), (1080, [300.0] * 6, 1), (1081, [299.0] * 6, 2), (1082, [299.0] * 6, 1)]
    rows += [(3000 + i, [0.5] * 6, i % 3) for i in range(40)]                       # many ties
    got, want = mined(spark, rows, **size), brute(rows)
    assert got == want and len(want) > 100


def test_no_rows_and_no_partners(spark):
    assert mined(spark, vectors(2, 3)[:0]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []


def test_very_large_components(spark):
    rows = [(0, [1e30, 1.0], 1), (2, [1e30, 2.0], 2), (3, [2e6, 1e6], 2), (10, [2e6, 2e6], 2), (5, [1e6, 1e6], 3), (1, [1e30, 1.0], 1)]
    assert mined(spark, rows) == brute(rows)
    exact = [r for r in rows if r[1][0] < 1e30]
    assert mined(spark, exact) == brute(exact) != []


def test_bounds_hold_and_walks_end_early():
    rng = random.Random(3)
    x = np.floor(256 * np.array([[rng.gauss(0, 1) for _ in range(8)] for _ in range(400)]))
    members = np.floor(x[:20] + 5)
    for m in (members, members[:1], -members, np.zeros((2, 8)), np.concatenate([members[:1], -members[:1]])):
        bound, length = H.bounds(m, x), np.linalg.norm(m, axis=1)
        assert (m @ x.T <= bound[None, :] * length[:, None] + 1e-6).all()
    tight = np.floor(1000 * (np.array([1, 1, 1, 1, 0, 0, 0, 0]) + 0.01 * np.array([[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)])))
    many = np.repeat(x, 20, axis=0)
    wanted = [[H.Wanted(-H._LIMIT - 1, H._LIMIT, 5)] for _ in tight]
    done = H.walk(tight, wanted, many, np.arange(len(many)), [str(i) for i in range(len(many))], [None] * len(tight))
    assert done < 0.5 * len(tight) * len(many)
    for m, (w,) in zip(tight, wanted):
        assert [(-s, i) for s, i, _, _ in w.rows] == sorted(((int(s), i) for i, s in enumerate(many @ m)), key=lambda t: (-t[0], t[1]))[:5]
