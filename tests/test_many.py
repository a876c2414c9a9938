"""Many questions a project, with filters, in blocks and parts of a few rows, against every pair."""

import random

import numpy as np
import pytest

from parchment.operators import many


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not len(a):
        return 0.0
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b) / n), 9) + 0.0 if n else 0.0


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "part": 20}])
def test_against_every_pair(spark, sizes):
    rng = random.Random(1)
    point = lambda: [float(rng.randrange(-3, 4)) for _ in range(4)]
    vectors = [("hot" if i % 5 else rng.choice(["a", "none"]), i, f"d{i % 7}", point()) for i in range(300)]
    vectors += [("hot", 300, "d1", None), ("hot", 301, "d1", []), ("hot", 302, "d1", [1.0]), (None, 303, "d1", point())]
    queries = [("hot", n, point(), None if n % 2 else ["d1", "d5"]) for n in range(11)] + [("a", 50, point(), None), ("a", 51, point(), []), ("b", 60, point(), None), ("hot", 70, [0.0] * 4, None), (None, 80, point(), None)]
    v = spark.createDataFrame(vectors, "project_id string, vec_id long, document_id string, embedding array<float>")
    q = spark.createDataFrame(queries, "project_id string, query_id long, query array<double>, documents array<string>")
    got = sorted((r.project_id, r.query_id, r["rank"], r.vec_id, r.score) for r in many.nearest(v, q, 5, 0.0, **sizes).collect())
    want = []
    for p, n, x, wanted in queries:
        held = sorted((-cosine(x, y), i) for o, i, d, y in vectors if o is not None and o == p and (wanted is None or d in wanted) and cosine(x, y) >= 0.0)
        want += [(p, n, k + 1, i, -s) for k, (s, i) in enumerate(held[:5])]
    assert [(*g[:4], round(g[4], 8)) for g in got] == [(*w[:4], round(w[4], 8)) for w in sorted(want)]
