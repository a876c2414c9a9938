import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parchment.llm.periodic import collapsed, common, find, mirrored, recompress, runs_of, strongest
from parchment.llm.queries import QUERIES
from tests.oracle import DATA


def brute(w):
    """Every period, every stretch, word by word."""
    stretches = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                stretches.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in stretches.items()), key=lambda r: (r[0], r[2]))


def texts(seed, n=60):
    rng, out = random.Random(seed), [[], [1], [1] * 5, [1] * 6, [1] * 100, [1, 2] * 3, [1, 2] * 4, list(range(50))]
    for _ in range(n):
        w = []
        while rng.random() < 0.8:
            piece = [rng.randrange(rng.choice((2, 3, 50))) for _ in range(rng.randrange(1, 9))]
            w += piece * rng.choice((1, 1, 2, 3, 4, 5, 9))
        out.append(w)
    return out


@pytest.mark.parametrize("seed", range(25))
def test_runs_against_brute_force(seed):
    own = texts(seed)
    assert runs_of(own) == list(map(brute, own))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
def test_any_texts(own):
    assert runs_of(own) == list(map(brute, own))


def test_extensions():
    """Common extensions of all pairs of places of one text, forward and back."""
    import numpy as np

    rng = random.Random(1)
    w = [-1, *[rng.randrange(2) for _ in range(40)], *[1, 0, 1] * 15, -2]
    words = np.array([x if x >= 0 else 9 - x for x in w])
    rounds = recompress(words, np.array([x < 0 for x in w]))
    assert len(rounds) > 4 and len(rounds[-1].symbols) < 10
    pairs = [(i, j) for i in range(1, len(w) - 1) for j in range(i + 1, len(w) - 1)]
    i, j = (np.array(x) for x in zip(*pairs))

    def length(a, b, step):
        n = 0
        while w[a + n * step] == w[b + n * step]:
            n += 1
        return n

    assert common(rounds, i, j).tolist() == [length(a, b, 1) for a, b in pairs]
    at = len(w) - 1
    assert common(mirrored(rounds), at - i, at - j).tolist() == [length(a, b, -1) for a, b in pairs]


def test_one_long_text():
    w = [7] * 30_000 + [1, 2, 3] * 20_000 + list(range(100, 5_000))
    assert runs_of([w]) == [[(0, 30_000, 1), (30_000, 60_000, 3)]]


def expected(text, doc_id):
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + p <= i < s + m for s, m, p in runs)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(kept)))


def test_query(spark):
    """All documents of the small table but those of over 2,000 words, for which the brute-force version takes too long; those
    are held against the same runs by the words' distances."""
    got = {r["doc_id"]: tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in QUERIES["op13_periodic_runs"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        if len((r["text"] or "").split()) <= 2000:
            assert got[r["doc_id"]] == expected(r["text"], r["doc_id"])
    assert sum(x[1] > 0 for x in got.values()) >= 10


def test_odd_rows(spark):
    long = "x y " * 30_000 + "end"
    rows = [(1, None, 5, 6), (2, "", 5, 6), (3, " \n\t ", 5, 6), (4, "a b " * 6, 5, 6), (4, "a b " * 6, 5, 6), (None, "q q q q q q", 5, 6), (7, long, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `runs` int, `a.b``c` int")
    got = find(df).collect()
    assert [c for c in find(df).columns] == ["doc_id", "text", "a.b`c", "n_words", "runs", "best", "collapsed"]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and all(r["a.b`c"] == 6 for r in got)
    assert [(by[i]["n_words"], by[i]["runs"], by[i]["best"], by[i]["collapsed"]) for i in (1, 2, 3)] == [(0, [], None, "")] * 3
    assert by[4]["runs"] == [(0, 6, 1)] and by[4]["collapsed"] == "a b" and by[None]["collapsed"] == "q"
    assert by[7]["runs"] == [(0, 60_000, 2)] and by[7]["collapsed"] == "x y end"
    assert find(df.limit(0)).collect() == []


def test_choice_and_collapse():
    assert strongest([(0, 8, 2), (3, 12, 3), (5, 12, 3)]) == (0, 8, 2) and strongest([(1, 9, 2), (2, 10, 2)]) == (2, 10, 2) and strongest([]) is None
    assert collapsed([b"a", b"b", b"a", b"b", b"a", b"b", b"a", b"b", b"c"], [(0, 8, 2)]) == b"a b c"
