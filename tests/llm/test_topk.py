import math
import random

import pytest
from pyspark.sql import functions as F

from parchment.llm.topk import search

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, asks, k=5):
    own = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in own if asks(i)}:
        v = min(v for i, v in own if i == q)
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in own if i != q))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def check(spark, rows, **bounds):
    got = search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, **bounds).collect()
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("bounds", [{}, {"bucket": 64, "block": 8}])
@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_random(spark, bounds, spread):
    rng = random.Random(3)
    scale = lambda: math.exp(rng.gauss(0, spread))
    rows = []
    for i in range(700):
        s = scale()
        rows.append((i, [float(int(s * rng.gauss(0, 1) * 64)) / 64 for _ in range(8)], 0))
    check(spark, rows, **bounds)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 0), (10, None, 0), (20, [1.0, None], 0), (30, [float("nan"), 1.0], 0), (40, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (50, [], 0), (60, [3.0], 0), (1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (70, [-1.0, -2.0], 0), (80, [0.0, 0.0], 0)]
    check(spark, rows)
    check(spark, [])
    check(spark, [(0, [1.0], 0)])


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 0.5, 0.25], 0) for i in range(400)] + [(1000 + i, [0.5, i / 64, 0.0], 0) for i in range(100)]
    check(spark, rows, bucket=32, block=16)


def test_large_components(spark):
    rows = [(0, [1e17, 1.0], 0), (1, [1e17, -3.0], 0), (2, [1e300, 0.5], 0), (10, [1e300, -1e300], 0), (3, [3e9, 7.5], 0), (20, [3e9, -2.25], 0), (4, [0.5, 1e308], 0), (5, [-1e308, 2.0], 0), (6, [1.0, 1.0], 0), (30, [0.25, 1.5], 0)]
    clamp = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
    whole = {i: [int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x) for x in v] for i, v, _ in rows}
    want = set()
    for q in (0, 10, 20, 30):
        scored = sorted((-clamp(sum(a * b for a, b in zip(whole[q], w))), i) for i, w in whole.items() if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])}
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    for bounds in ({}, {"bucket": 2, "block": 1}):
        assert {tuple(r) for r in search(wide, F.col("vec_id") % 10 == 0, **bounds).collect()} == want
