"""The pipeline's near copies come from SimHash fingerprints, and from nothing else."""

import random

import numpy as np
import pytest

import corpus_pipeline as P
from parchment.llm import jaccard as J
from parchment.llm import simhash as S
from tests.oracle import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edited(spark, n: int = 40):
    """Pairs of similarity 0.84: one of 60 words is another one."""
    rng, rows = random.Random(1), []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        rows.append((2 * i, " ".join(words), "en", "a", 0))
        words[30] = "other"
        rows.append((2 * i + 1, " ".join(words), "en", "a", 0))
    return spark.createDataFrame([*rows, (500, *rows[0][1:])], SCHEMA)


def test_stage_by_fingerprints(spark, monkeypatch):
    """All near copies go by links of fingerprints; without these only a text's exact copy goes."""
    df, seen, links = edited(spark), [], S.wide_links
    monkeypatch.setattr(S, "wide_links", lambda prints: seen.append(prints.columns) or links(prints))
    assert sorted(r.doc_id for r in P.near_copies(spark, df, DATA).collect()) == list(range(0, 80, 2)) and len(seen) == 1
    monkeypatch.setattr(S, "wide_links", lambda prints: links(prints.limit(0)))
    assert sorted(r.doc_id for r in P.near_copies(spark, df, DATA).collect()) == list(range(80))


def hashes(rng, n: int) -> np.ndarray:
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)


@pytest.mark.parametrize(("both", "a", "b"), [(4, 1, 0), (8, 1, 1), (80, 10, 10), (320, 40, 40)])
def test_similarity_of_four_fifths(both, a, b):
    """Each pair has an equal key in some table, and is near."""
    rng, x, y = np.random.default_rng(both), [], []
    for _ in range(300):
        common = hashes(rng, both)
        x.append(np.concatenate([common, hashes(rng, a)]))
        y.append(np.concatenate([common, hashes(rng, b)]))
    (keys, words), (keys2, words2) = S.wide_prints(x), S.wide_prints(y)
    same = keys == keys2
    assert np.all([np.roll(same, -c, axis=1) for c in S.CHOICE], axis=0).any(axis=1).all()
    assert (np.bitwise_count(words ^ words2).sum(axis=1) <= S.WIDE_RADIUS).all()
    # neighbours have nothing in common
    assert (np.bitwise_count(words[1:] ^ words[:-1]).sum(axis=1) > S.WIDE_RADIUS).mean() > 0.99
    assert (S.wide_prints(x, S.COMPARED)[1] == words).all()


@pytest.mark.parametrize("small", [2, 12, 256])
def test_wide_links_of_a_bucket(small):
    """Pair by pair or in slices: the same texts hang together."""
    rng = np.random.default_rng(5)
    fps = np.repeat(hashes(rng, 20).reshape(10, 2), 15, axis=0)
    fps ^= np.uint64(1) << rng.integers(0, 64, fps.shape, dtype=np.uint64)
    if len(fps) <= small:
        x, y = S.small_links(fps, np.array([0]), np.array([len(fps)]), 8)
        pairs = [*zip(x.tolist(), y.tolist())]
    else:
        pairs = S.large_links(fps, 8)
    label = list(range(len(fps)))
    for x, y in pairs:
        label = [label[x] if v == label[y] else v for v in label]
    assert len({*label}) == 10 and all(len({*label[k : k + 15]}) == 1 for k in range(0, 150, 15))


@pytest.mark.parametrize("tile", [4096, 8])
def test_hot_buckets(spark, tile):
    """Buckets in tiles join the same texts."""
    df = edited(spark).where("doc_id < 500").selectExpr("doc_id", "text")
    columns = ", ".join(f"{w} long" for w in S.WIDE)
    prints = df.mapInArrow(J._prints, f"doc_id long, words binary, keys binary, {columns}").withColumnRenamed("doc_id", "id")
    got = {(min(r), max(r)) for r in S.wide_links(prints.localCheckpoint(), tile).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(40)}


def prints_of(df):
    columns = ", ".join(f"{w} long" for w in S.WIDE)
    return df.mapInArrow(J._prints, f"doc_id long, words binary, keys binary, {columns}").withColumnRenamed("doc_id", "id").localCheckpoint()


def one_group(spark, n: int):
    """n texts of 200 words, each with two words of its own: all near one another."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(i, " ".join([f"x{i}", *base[1:-1], f"y{i}"])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def reached(links: list) -> dict:
    root = {i: i for r in links for i in r}
    for x, y in links:
        low, high = sorted((root[x], root[y]))
        root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_links_of_a_large_group(spark):
    """Not a link for each pair, nor one for each table."""
    got = [tuple(r) for r in S.wide_links(prints_of(one_group(spark, 200))).collect()]
    assert len(got) < 2 * 200 and set(reached(got).values()) == {0} and len(reached(got)) == 200


@pytest.mark.parametrize("n", [100, 300])
def test_links_of_a_bucket(n):
    """Small or large, one bucket gives fewer links than texts; texts of one id give none."""
    import pyarrow as pa

    def made(ids):
        cols = [np.full(n, 5), np.zeros(n, np.int64), np.full(n, 77), np.full(n, -1), ids]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "cell", *S.WIDE, "id"])
        out = [b.to_pydict() for b in S._link(S.WIDE_RADIUS, S.WIDE_SMALL, S.ROWS)(iter([batch]))]
        return [p for b in out for p in zip(b["a"], b["b"])]

    assert sorted(made(np.arange(n))) == [(i, 0) for i in range(1, n)]
    assert made(np.arange(n) // (n // 2)) == [(1, 0)]
    assert made(np.zeros(n, np.int64)) == []


def test_stars():
    rng = np.random.default_rng(3)
    a, b = rng.permutation(2000)[rng.integers(0, 2000, (2, 1500))]
    path = rng.permutation(np.arange(5000, 9000))
    a, b = np.concatenate([a, path[1:]]), np.concatenate([b, path[:-1]])
    want = reached([*zip(a[:1500].tolist(), b[:1500].tolist())]) | dict.fromkeys(range(5000, 9000), 5000)
    assert {*zip(*(c.tolist() for c in S.stars(a, b)))} == {(i, r) for i, r in want.items() if i != r}
    assert [len(c) for c in S.stars(a[:0], b[:0])] == [0, 0]


def test_tables_after_the_first(spark):
    """What no early table joins, later ones do, also to texts that are joined already."""
    prints = prints_of(edited(spark).unionByName(one_group(spark, 30).selectExpr("doc_id + 1000 AS doc_id", "text", "'' AS lang", "'' AS source", "0L AS n_chars")).where("doc_id != 500").selectExpr("doc_id", "text"))
    want = {i: i - i % 2 for i in range(80)} | dict.fromkeys(range(1000, 1030), 1000)
    for first in (1, 8, 127):
        assert reached([tuple(r) for r in S.wide_links(prints, first=first).collect()]) == want


def test_links_across_tiles(spark):
    """Tiles of one large group are joined by few links, not by one for each text and tile."""
    df = one_group(spark, 300)
    got = [tuple(r) for r in J.near_links(prints_of(df), df.withColumnRenamed("doc_id", "id"), tile=16).collect()]
    assert len(got) < 2 * 300 and set(reached(got).values()) == {0} and len(reached(got)) == 300
