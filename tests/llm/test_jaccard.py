"""The pipeline's near-copy stage against brute-force Jaccard similarity of 5-word shingles."""

import random

import pytest

import corpus_pipeline as P
from parchment.llm import jaccard as J
from tests.oracle import DATA


def shingles(text: str | None) -> set:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute(rows: list[tuple]) -> dict:
    """The least id reachable for each id; rows (id, text)."""
    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                x, y = root[i], root[j]
                root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
    return root


def kept(spark, rows: list[tuple]) -> list[int]:
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r.doc_id for r in P.near_copies(spark, df, DATA).collect())


def varied(seed: int, groups: int, each: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 200, 1000]))]
        for _ in range(each):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(3000)}"
            rows.append(words)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_one_changed_word(spark):
    """Similarity 0.84: most such pairs differ in more than three bits of a fingerprint."""
    rng, rows = random.Random(1), []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        rows.append((2 * i, " ".join(words)))
        words[30] = "other"
        rows.append((2 * i + 1, " ".join(words)))
    assert kept(spark, rows) == [2 * i for i in range(40)]


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert kept(spark, rows + rows) == sorted(i for i, r in brute(rows).items() if i == r)


@pytest.mark.parametrize(("tile", "wide"), [(512, 4096), (8, 4096), (8, 1), (512, 10)])
def test_groups(spark, tile, wide):
    """Whole groups, groups in tiles, groups by their buckets."""
    rows = varied(3, 8, 40) + [(900, None), (901, " \t"), (902, "One two"), (903, "one  TWO"), (904, "one three"), (904, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.node: r.root for r in J.copies(df, tile, wide).collect()}
    want = brute([r for r in rows if r[0] < 900]) | {900: 900, 901: 900, 902: 902, 903: 902, 904: 902}
    assert {i: got.get(i, i) for i in want} == want and len({*want.values()}) < len(want)
    assert J.copies(df.limit(0), tile).count() == 0
