import pytest

from parchment.llm.mixing import mix, repeat

SCHEMA = "doc_id long, text string, source string, size string"


def rows_of(spark, docs):
    return spark.createDataFrame([(i, t, s, "clash") for i, t, s in docs], SCHEMA)


def fill(sizes: dict, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0) -> dict:
    """Clamp, share what is over by weight, again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        aim = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if aim[s] > most * sizes[s]]
        if not over:
            return held | aim
        held |= {s: most * sizes[s] for s in over}


def test_targets_and_taken(spark):
    docs = [(i, "w " * (i % 40), ["a", "b", "é", "c", None][i % 5 if i % 3 else 0]) for i in range(2000)] + [(5000, None, "a"), (5001, "", "empty"), (5, "w " * 5, "b"), (None, "w w", "b")]
    df = rows_of(spark, docs)
    got = mix(df).collect()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = fill(sizes), {s: 0 for s in sizes}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    key = lambda r: (r.doc_id or -1, r.source or "", r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mix(df.repartition(7)).collect()))


def test_hot_source(spark):
    got = mix(rows_of(spark, [(i, "w " * (1 + i % 3), "hot" if i % 3 else f"s{i % 5}") for i in range(5000)])).groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 1 for r in got)


def test_repeat(spark):
    docs = [(i, f"a{i} b{i} c{i}", "s" if i % 2 else "t") for i in range(40)] + [(100, None, "s")]
    df = rows_of(spark, docs)
    mixed = mix(df)
    out = repeat(mixed, ["doc_id", "text", "source"]).collect()
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    for i, n in taken.items():
        assert sum(len((r.text or "").split()) for r in out if r.doc_id == i) == n
    assert sum(r.doc_id == 100 for r in out) == 1


def test_empty(spark):
    assert mix(rows_of(spark, [])).count() == 0
    assert mix(rows_of(spark, [(1, None, None)])).first().taken == 0
