import hashlib
import random

import numpy as np
import pytest

from parchment.llm import substring as S
from parchment.llm.queries import op4_substring_dedup
from tests.oracle import DATA

SCHEMA = "doc_id long, text string, kept_text int"


def brute(rows, window=20):
    """rows (doc_id, text): kept text and removed words of each."""
    first, words = {}, [(t or "").encode().split() for _, t in rows]
    key = [float("inf") if i is None else i for i, _ in rows]
    for i, w in zip(key, words):
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in zip(key, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone |= set(range(s, s + window))
        out.append((b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(gone)))
    return out


def check(spark, rows, **bounds):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.kept_text, r.n_removed, sum(s.length for s in r.removed)) for r in S.dedup(df, **bounds).collect()))
    want = sorted(((i is None, i or 0, k, n, n) for (i, _), (k, n) in zip(rows, brute(rows))))
    assert got == want


@pytest.mark.parametrize("bounds", [{}, {"chunk_bytes": 500, "bucket_bytes": 800}])
def test_random_repeats(spark, bounds):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)
    passages = [[word() for _ in range(rng.randint(15, 60))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [word() for _ in range(rng.randint(0, 40))] + rng.choice(passages)
        rows.append((rng.randint(0, 10_000), rng.choice([" ", "\n", "\t "]).join(w)))
    check(spark, rows, **bounds)


def test_odd_rows(spark):
    same, long = " ".join("abcdefghijklmnopqrstuvwxyz"), " ".join(str(i) for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "short text"), (5, same), (5, same), (4, same), (None, same), (None, same + " z"), (8, long), (7, "x " + long), (9, "w " * 100), (10, "w " * 19), (11, "\xa0" + same)]
    check(spark, rows)
    assert S.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)]
    check(spark, rows, chunk_bytes=2000)


def test_rolling():
    v = np.random.default_rng(0).integers(0, 1 << 63, 50, dtype=np.uint64)
    for size in (1, 7, 10, 20):
        h = S.rolling(v, size, 0x9E3779B97F4A7C15)
        assert len(h) == 51 - size
        assert h[3] == S.rolling(v[3 : 3 + size], size, 0x9E3779B97F4A7C15)[0]
    assert len(S.rolling(v, 60, 3)) == 0


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = brute([(d.doc_id, d.text) for d in docs])
    got = {r.doc_id: r for r in op4_substring_dedup(spark, DATA).collect()}
    for d, (kept, n) in zip(docs, want):
        r = got[d.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(d.text.encode().split()), n, hashlib.sha256(kept.encode()).hexdigest())
