import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parchment.llm import quality_model as Q
from parchment.llm.labelled import fitted, held_out, sample
from parchment.llm.queries import op9_quality_model

SF = "/root/testdata/sf0.1"


def made(n: int, seed: int) -> list[tuple[str, int]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 120))]
        rows.append((" ".join(w) + "." if i % 2 else " ".join(f"{x.upper()}!!" for x in w), i % 2))
    return rows


def test_shapes():
    assert [Q.shape(w) for w in ("Don't", "ABC!!", "12", "a%%%", "Éa", "")] == ["Aa'a", "AA!!", "9", "a%%", "Aa", ""]


def test_learns_shapes():
    model, held = Q.train(made(300, 1)), made(200, 2)
    scores = model.score([t for t, _ in held])
    assert sum((s >= 0.3) == y for s, (_, y) in zip(scores, held)) == 200


def test_odd_rows(spark):
    model = Q.train(made(100, 3))
    rows = [(1, None, 5), (2, "", 5), (3, "word " * 60_000, 5), (3, "word " * 60_000, 5), (4, "x", 5)]
    got = Q.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score and got[2].score == got[3].score
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.score(docs, Q.fit(docs, none)).first().score == 0.0
    assert Q.score(docs.limit(0), model).count() == 0


def plain_grams(text: str) -> list[int]:
    """Places of n-grams by the definition, one by one."""
    k, mod, words = 0x9E3779B97F4A7C15, 1 << 64, text.encode().split()
    w = [xxhash.xxh64_intdigest(x) for x in words]
    s = [xxhash.xxh64_intdigest(Q.shape(x.decode()), 1) for x in words]
    found = [*w, *(a * k + b + 7 for a, b in zip(w, w[1:])), *s, *(a * k + b + 11 for a, b in zip(s, s[1:]))]
    found += [a * k * k + b * k + c + 13 for a, b, c in zip(s, s[1:], s[2:])]
    return [((x % mod ^ x % mod >> 32) * 0xD6E8FEB86659FD93 % mod) >> 44 for x in found]


def plain_inputs(text: str) -> dict[int, float]:
    g = plain_grams(text)
    return {p: g.count(p) / len(g) ** 0.5 for p in set(g)} if g else {}


def test_same_as_plain_ftrl():
    rows = [*made(24, 6), ("", 1), ("solo", 0)]
    alpha, beta, l1, l2, bias = 0.3, 1.0, 0.02, 0.05, -1
    z, n = Counter(), Counter()

    def weight(p: int) -> float:
        return 0.0 if abs(z[p]) <= l1 else -(z[p] - math.copysign(l1, z[p])) / ((beta + n[p] ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for i in order.permutation(len(rows)):
            x = plain_inputs(rows[i][0]) | {bias: 1.0}
            w = {p: weight(p) for p in x}
            error = 1 / (1 + math.exp(-sum(w[p] * v for p, v in x.items()))) - rows[i][1]
            for p, v in x.items():
                g = error * v
                z[p] += g - ((n[p] + g * g) ** 0.5 - n[p] ** 0.5) / alpha * w[p]
                n[p] += g * g
    model = Q.train(rows)
    want = np.zeros(Q.DIMS)
    for p in z:
        if p != bias:
            want[p] = weight(p)
    assert np.allclose(model.weights, want, atol=1e-6) and model.bias == pytest.approx(weight(bias))
    texts = [*(t for t, _ in made(10, 7)), None, "", "a"]
    for text, s in zip(texts, model.score(texts)):
        said = sum(weight(p) * v for p, v in plain_inputs(text or "").items()) + weight(bias)
        assert s == pytest.approx(1 / (1 + math.exp(-said)), abs=1e-6)


def test_share_of_labels(spark):
    rows = made(400, 8)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows) if y == 0 or i % 8 == 1], "doc_id long, quality int")
    few, every = Q.fit(docs, labels, per_class=20), Q.fit(docs, labels)
    n = labels.where(~held_out(F.col("doc_id"), 5, 0)).groupBy("quality").count().collect()
    n = {r.quality: r["count"] for r in n}
    plain = fitted(sample(docs, labels, "quality", 5, 0, 20, 20_000), Q.train)[0]
    assert few.bias - plain.bias == pytest.approx(math.log(n[1] / n[0]))
    assert every.bias == fitted(sample(docs, labels, "quality", 5, 0, 3000, 20_000), Q.train)[0].bias


def test_training_is_repeatable():
    assert (Q.train(made(60, 4)).weights == Q.train(made(60, 4)).weights).all()


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op9_quality_model(spark, SF).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(got) > 600 and sum(r.predicted == r.quality for r in got) / len(got) > 0.97
