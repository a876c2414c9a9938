import math
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parchment.llm import toxicity as X
from parchment.llm.labelled import held_out
from parchment.llm.queries import op8_toxicity

SF = "/root/testdata/sf0.1"
CLEAN = [a + b for a, b in product("bcdfglmnprst", ("ario", "elan", "imor", "onda", "ulit"))]
BAD = ["vilewort", "grimtoad", "foulmuck"]


def made(n: int, seed: int) -> list[tuple[str, int]]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = rng.choices(CLEAN, k=rng.randint(5, 150))
        if i % 2:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((" ".join(w), i % 2))
    return rows


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    scores, table = rng.normal(size=5), rng.normal(size=(2, 2))
    total = [np.exp(sum(scores[t] * y[t] for t in range(5)) + sum(table[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=5)]
    p = [sum(z for y, z in zip(product((0, 1), repeat=5), total) if y[t]) / sum(total) for t in range(5)]
    pair = np.zeros((2, 2))
    for y, z in zip(product((0, 1), repeat=5), total):
        for a, b in zip(y, y[1:]):
            pair[a, b] += z / sum(total)
    odds, *rest = X.marginals(scores, np.array([5]), table)
    assert np.allclose(odds / (1 + odds), p)
    assert np.allclose(X.pairs(*rest, table, X.followed(np.array([5]))), pair)


def plain_odds(scores: list[float], table: np.ndarray) -> list[float]:
    """Forward-backward over a whole text, word by word."""
    e, m, ahead, back = [math.exp(min(30, max(-30, s))) for s in scores], np.exp(table), [], [1.0]
    for x in e:
        ahead.append(x * (m[0, 1] + m[1, 1] * ahead[-1]) / (m[0, 0] + m[1, 0] * ahead[-1]) if ahead else x)
    for x in reversed(e[1:]):
        back.append((m[1, 0] + m[1, 1] * x * back[-1]) / (m[0, 0] + m[0, 1] * x * back[-1]))
    return [a * b for a, b in zip(ahead, reversed(back))]


@pytest.mark.parametrize("spread", [1.0, 12.0])
def test_texts_are_whole_chains(spread):
    rng = np.random.default_rng(2)
    sizes = np.array([0, 3, 64, 65, 1, 0, 128, 129, 1000, 63, 5000, 0])
    scores, table = rng.normal(size=sizes.sum()) * spread, rng.normal(size=(2, 2)) * 2
    odds = X.marginals(scores, sizes, table)[0]
    ends = np.cumsum(sizes)
    want = [o for z, n in zip(ends, sizes) if n for o in plain_odds(scores[z - n : z].tolist(), table)]
    assert np.allclose(np.log(odds), np.log(want), atol=1e-9)


def plain_scores(model: X.Model, text: str | None) -> tuple[float, list[tuple[int, int]]]:
    """A text's score and spans by the definition: no segments, no caches."""
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
    if not words:
        odds, inputs = [], [1.0, -12.0, 0.0]
    else:
        own = [float(model.weights[-1]) + sum(float(model.weights[xxhash.xxh64_intdigest(f) % X.DIMS]) for f in X.features(w.group())) for w in words]
        odds = plain_odds(own, model.table)
        inputs = [1.0, min(12, max(-12, math.log(max(odds)))), math.log1p(sum(o / (1 + o) for o in odds if o > 0.25))]
    spans, last = [], None
    for i, o in enumerate(odds):
        if o >= 1:
            if last == i - 1 and spans:
                spans[-1] = (spans[-1][0], words[i].end())
            else:
                spans.append(words[i].span())
            last = i
    return 1 / (1 + math.exp(-min(30, max(-30, float(np.dot(inputs, model.document)))))), spans


def test_same_as_plain_scorer(spark, monkeypatch):
    model = X.train(made(400, 5))
    texts = [t for t, _ in made(60, 6)] + [None, "", " \n", "x", " ".join(f"{c} {b}" for c in CLEAN for b in (BAD[0], c) * 9), f"{BAD[1]}, {BAD[2]}! \u00a0 end"]
    monkeypatch.setattr(X, "TOGETHER", 200)  # several runs of texts, some of one long text
    scores, spans = X.Tagger(model).documents(texts, 0.5)
    for text, s, found in zip(texts, scores, spans):
        want, places = plain_scores(model, text)
        assert s == pytest.approx(want, abs=1e-9) and [(x["start"], x["end"]) for x in found] == places


def test_spans_and_scores(spark):
    model = X.train(made(600, 1))
    rows = [(1, f"rario Grimtoad, {BAD[0]} belan", 9), (2, "rario belan bimor", 9), (3, None, 9), (4, "", 9), (5, "rario " * 40_000 + "foulmuck", 9), (2, "rario belan bimor", 9)]
    got = {r.doc_id: r for r in X.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()}
    assert got[1].score > 0.5 and got[5].score > 0.5 and max(got[i].score for i in (2, 3, 4)) < 0.3
    assert [rows[0][1][s.start : s.end] for s in got[1].toxic_spans] == [f"Grimtoad, {BAD[0]}"]
    assert got[2].toxic_spans == got[3].toxic_spans == []
    held = made(300, 2)
    scores = X.Tagger(model).documents([t for t, _ in held], 0.5)[0]
    assert sum((s >= 0.3) == y for s, (_, y) in zip(scores, held)) > 290


def test_training_is_repeatable():
    a, b = X.train(made(100, 3)), X.train(made(100, 3))
    assert (a.weights == b.weights).all() and (a.document == b.document).all()


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in X.score(docs, X.fit(docs, none)).collect()] == [0.0, 0.0]
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), (1, 1)], "doc_id long, toxic int")
    assert [r.score for r in X.score(docs, X.fit(docs, odd)).collect()] == [1.0, 1.0]
    assert X.score(docs.limit(0), X.fit(docs, none)).count() == 0


def test_held_out(spark):
    got = spark.range(50).select("id", held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op8_toxicity(spark, SF).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert len(got) > 800 and hits / sum(r.toxic for r in got) >= 0.9 and hits / sum(r.predicted for r in got) > 0.9
