import random

import numpy as np
import pytest
import xxhash

from parchment.llm import simhash as S
from parchment.llm.components import components
from parchment.llm.queries import op6_simhash
from tests.oracle import DATA


def print_of(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(prints: list[int], ids: list[int]) -> dict:
    fp, up = np.array(prints, np.uint64), list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            up[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
    least = {}
    for i in range(len(ids)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return {(ids[i], prints[i]): least[find(i)] for i in range(len(ids))}


def near(seed: int, centres: int, each: int, flips: int) -> list[int]:
    rng = np.random.default_rng(seed)
    out = set()
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64):
        for _ in range(each):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
                x ^= 1 << int(b)
            out.add(x)
    return sorted(out)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("tile", [4096, 16])
def test_links_join_all_near_prints(spark, tile):
    fps = near(0, 12, 80, 5)
    df = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, id long")
    got = {r.node: r.root for r in components(S.near_links(df, tile=tile)).collect()}
    want = roots_of(fps, list(range(len(fps))))
    assert {i: got.get(i, i) for i in range(len(fps))} == {i: r for (i, _), r in want.items()}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_counters(radius):
    rng = np.random.default_rng(radius)
    values = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), False)) for _ in range(1000)], np.uint64)
    planes = S.planes_of(values)
    blocks, words = S.within(lambda b, x: planes[b][x], planes.shape[1], radius)
    hit = S._lanes(blocks, words)
    assert sorted(hit[hit < 1000]) == np.flatnonzero(np.bitwise_count(values) <= radius).tolist()


def test_prints():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["Ä", "b", "C", "d\xa0e", " "], k=rng.randint(0, 700))) for _ in range(40)] + [None, "", "one", "One TWO", " \x0b\t", "a b c"]
    assert S.fingerprints(texts).tolist() == [print_of(t) for t in texts]
    assert S.fingerprints([]).tolist() == []


def test_components(spark):
    path = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 200), (300, 300), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hub(spark):
    star = [(500, i) for i in range(500)] + [(i, 10_000 + i) for i in range(500)]
    got = components(spark.createDataFrame(star, "a long, b long")).collect()
    assert len(got) == 1000 and {r.root for r in got} == {0}


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(50_000))
    rows = [(1, None, 1), (2, "", 1), (3, "x y z", 1), (3, "x y z", 1), (4, "X Y\tZ", 1), (5, long, 1), (6, long + " end", 1), (None, "x y z", 1), (7, "q", 1), (7, "x y z", 1)]
    got = [(r.doc_id, r.component_id) for r in S.near_copies(spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (5, 5), (6, 5), (None, 3), (7, 3), (7, 3)], key=str)
    assert S.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = roots_of([print_of(d.text) for d in docs], [d.doc_id for d in docs])
    got = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in op6_simhash(spark, DATA).collect()}
    assert got == want
