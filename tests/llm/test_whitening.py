import math

import numpy as np
import pytest

from parchment.llm.queries import QUERIES
from parchment.llm.whitening import MOST, Slicer, components, factorise
from tests.oracle import DATA

SCHEMA = "vec_id long, embedding array<double>, v string"


def brute(rows, k=32):
    """Whole numbers of any length, and a library's eigenvectors."""
    own = [(i, v) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in own), default=0)
    xs = [[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in own]
    n = len(xs)
    sums = [sum(x[d] for x in xs) for d in range(width)]
    cov = np.array([[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in xs) / n**3 for b in range(width)] for a in range(width)]).reshape(width, width)
    values, vectors = np.linalg.eigh(cov) if width else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = values[::-1][:k], vectors.T[::-1][:k]
    out = {}
    for (i, _), x in zip(own, xs):
        off = [n * a - s for a, s in zip(x, sums)]
        for c in range(len(values)):
            if values[c] > 1e-9 * max(1e-300, values[0]):
                out.setdefault((i, c + 1), []).append((n, sum(a * a for a in off), float(np.dot([a / n for a in off], vectors[c]) / math.sqrt(values[c])), values[c] / np.trace(cov)))
    return out


def check(got, want):
    assert sorted((r["vec_id"] is not None, r["vec_id"], r["component"]) for r in got) == sorted((i is not None, i, c) for (i, c), rows in want.items() for _ in rows)
    signs = {}
    for r in got:
        n, deviation, value, explained = min(want[r["vec_id"], r["component"]], key=lambda w: abs(abs(w[2]) - abs(r["whitened"])))
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - abs(value)) < 1e-8 and abs(r["explained"] - explained) < 1e-9 * explained + 1e-15 and r["identity_error"] < 1e-9
        if abs(value) > 1e-6:
            signs.setdefault(r["component"], set()).add(r["whitened"] * value > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_random(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(6) * [1, 2, 3, 4, 5, 6]], "x") for i in range(150)]
    check(components(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows))
    assert {r["component"] for r in components(spark.createDataFrame(rows, SCHEMA), k=3).collect()} == {1, 2, 3}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, "x"), (2, [1.0, None], "x"), (3, [nan, 1.0], "x"), (4, [1.0, -inf], "x"), (5, [1.0, 2.0, 0.5], "x"), (5, [1.0, 2.0, 0.5], "x"), (6, [3.0], "x"), (7, [], "x"), (8, [-2.0, 1.5, 9.0], "x")]
    check(components(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows))
    nobody = spark.createDataFrame([(None, [1.0, 2.0], "x"), (1, [2.0, 5.0], "x"), (2, [4.0, 1.0], "x")], SCHEMA)
    assert sorted((r["vec_id"] or 0, r["component"]) for r in components(nobody).collect()) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2)]
    for none in ([], [(1, [1.0, 2.0], "x")], [(i, [1.0, 2.0], "x") for i in range(9)], [(1, [], "x"), (2, [], "x")]):
        assert components(spark.createDataFrame(none, SCHEMA)).collect() == []


def test_far_components(spark):
    rows = [(i, [float(i), 1e300 if i == 3 else 0.25 * i], "x") for i in range(5)]
    got = components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["deviation"] for r in got} == {MOST} and {r["component"] for r in got} == {1} and all(math.isfinite(r["whitened"]) for r in got)
    wide = [(i, [float((i * 7919) % 1000) * 1e3, float((i * 104729) % 997)], "x") for i in range(40)]
    check(components(spark.createDataFrame(wide, SCHEMA)).collect(), brute(wide))


@pytest.mark.parametrize("a", [np.eye(12) * 3, np.diag([5.0, 5, 5, 2, 2, 1, 0, 0]), np.ones((6, 6)), np.diag([1.0, 1 + 1e-15, 1 + 1e-12, 1 + 1e-9, 0.5])])
def test_clusters(a):
    values, vectors = Slicer(a).leading(32)
    want = np.linalg.eigvalsh(a)[::-1]
    assert len(values) == (want > 1e-12).sum() and np.abs(values - want[: len(values)]).max() < 1e-14 * max(1, want[0])
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12 and np.abs(vectors @ a - values[:, None] * vectors).max() < 1e-14 * max(1, want[0])


def test_inertia_and_solve():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 20):
        a = rng.standard_normal((n, n))
        a = a + a.T
        for s in (-1.0, 0.0, 0.7):
            f = factorise(a, s, 1e-15)
            assert f.above() == (np.linalg.eigvalsh(a) > s).sum()
            b = rng.standard_normal(n)
            assert np.allclose((a - s * np.eye(n)) @ f.solve(b), b)
    zero = np.array([[0.0, 1.0], [1.0, 0.0]])  # no pivot on the diagonal
    assert factorise(zero, 0.0, 1e-15).above() == 1


def test_query(spark):
    """The whole table: every row, all components, the identity measured again."""
    got = QUERIES["op11_whitening"](spark, DATA).toPandas()
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    assert len(got) == len(e) * 32 and set(got["n"]) == {len(e)}
    x = np.floor(np.array(e["embedding"].tolist(), float) * 64) + 1e6
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    z = got.pivot(index="vec_id", columns="component", values="whitened").loc[e["vec_id"]].to_numpy()
    assert np.abs(np.cov(z.T, bias=True) - np.eye(32)).max() < 1e-10 and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    want = (x - x.mean(axis=0)) @ vectors[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    assert np.abs(np.abs(z) - np.abs(want)).max() < 1e-8
    assert np.allclose(got.groupby("component")["explained"].first(), values[::-1][:32] / values.sum(), rtol=1e-9)
    one = got[got["component"] == 1].set_index("vec_id")["deviation"].loc[e["vec_id"]].to_numpy()
    xs = x.astype(np.int64)
    assert (one == ((len(e) * xs - xs.sum(axis=0)) ** 2).sum(axis=1)).all()
