from collections import defaultdict

from parchment.llm.sharding import shard

SCHEMA = "doc_id long, text string, shard string"


def test_shards_fit_and_tile(spark):
    rows = [(i, "x" * (i % 97), "clash") for i in range(3000)] + [(7, "y" * 5000, ""), (None, "n" * 40, ""), (9_999, None, ""), (9_999, None, "")]
    limit = 2000
    got = shard(spark.createDataFrame(rows, SCHEMA), limit=limit).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.doc_bytes
        assert len(r.shard) == r.depth
    for r in got:
        assert r.shard_bytes == size[r.shard] and (r.oversize == (size[r.shard] > limit))
    assert [r.doc_id for r in got if r.oversize] == [7, 7]  # rows of one key can't be parted
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for name in names:  # only a bucket above the limit was split
        if name:
            assert sum(s for n, s in size.items() if n.startswith(name[:-1])) > limit


def test_one_shard_and_none(spark):
    assert {r.shard for r in shard(spark.createDataFrame([(1, "a", ""), (2, None, "")], SCHEMA)).collect()} == {""}
    assert shard(spark.createDataFrame([], SCHEMA)).count() == 0
