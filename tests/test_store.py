"""Tables under manifests: what a change writes, what readers see, two writers at once."""

import os
import threading


from parchment.sources.store import Conflict, Store

SCHEMA = "project_id string, id long, v string"


def files(root) -> set[str]:
    return {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def seen(store, name="t", version=None):
    return sorted(((r.project_id, r.id, r.v) for r in store.read(name, version).collect()), key=str)


def test_upsert_writes_one_project(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.write("t", spark.createDataFrame([(f"p{i % 5}", i, "a") for i in range(40)] + [(None, 99, "n"), ("p/ ?", 98, "odd")], SCHEMA))
    before = files(tmp_path)
    store.upsert("t", spark.createDataFrame([("p2", 7, "new"), ("p2", 100, "more")], SCHEMA), ["id"])
    new = files(tmp_path) - before
    assert 1 <= len(new) <= 2 and len({os.path.dirname(f) for f in new}) == 1  # one row moves in p2's files
    got = {i: (p, v) for p, i, v in seen(store)}
    assert len(got) == 43 and got[7] == ("p2", "new") and got[100] == ("p2", "more") and got[99] == (None, "n") and got[98] == ("p/ ?", "odd")
    assert len(seen(store, version=1)) == 42  # the version before is still there
    store.upsert("t", spark.createDataFrame([("p9", 7, "moved")], SCHEMA), ["id"])
    assert [r for r in seen(store) if r[1] == 7] == [("p9", 7, "moved")]
    store.upsert("t", spark.createDataFrame([(None, 99, "again")], SCHEMA), ["project_id", "id"])
    assert [r for r in seen(store) if r[1] == 99] == [(None, 99, "again")]


def test_columns_are_added(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.write("t", spark.createDataFrame([("p", 1, "a"), ("q", 2, "b")], SCHEMA))
    store.upsert("t", spark.createDataFrame([("p", 3, True)], "project_id string, id long, flag boolean"), ["id"])
    assert sorted((r.id, r.v, r.flag) for r in store.read("t").collect()) == [(1, "a", None), (2, "b", None), (3, None, True)]


def test_tombstones_and_compaction(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.write("t", spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q", 3, "a")], SCHEMA))
    before = files(tmp_path)
    store.delete(["t", "none"], v="a")
    assert files(tmp_path) == before and seen(store) == [("p", 2, "b")]
    store.append("t", spark.createDataFrame([("p", 4, "a")], SCHEMA))  # came after the tombstone
    assert seen(store) == [("p", 2, "b"), ("p", 4, "a")]
    store.compact("t")
    assert seen(store) == [("p", 2, "b"), ("p", 4, "a")] and store.manifest("t").tombstones == [] and max(map(len, store.manifest("t").folders.values())) == 1
    store.delete(["t"], project_id="p")
    assert seen(store) == []
    store.prune("t", keep=1)
    assert files(tmp_path) == set() and store.versions("t") == [5]
    store.delete(["t"], absent=1)  # no such column: nothing happens
    assert store.versions("t") == [5]


def test_two_writers(spark, tmp_path):
    """Both start from one version; one commits, the other fails cleanly and leaves the table as it is."""
    store, barrier, result = Store(spark, f"file://{tmp_path}"), threading.Barrier(2), []
    store.write("t", spark.createDataFrame([("p", 1, "a")], SCHEMA))

    class Slow(Store):
        def _commit(self, name, made):
            barrier.wait(60)
            super()._commit(name, made)

    def run(v):
        try:
            Slow(spark, f"file://{tmp_path}").upsert("t", spark.createDataFrame([("p", 1, v)], SCHEMA), ["id"])
            result.append(v)
        except Conflict:
            result.append("conflict")

    threads = [threading.Thread(target=run, args=(v,)) for v in "xy"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(result)[0] == "conflict" and len(result) == 2
    (won,) = set(result) - {"conflict"}
    assert seen(store) == [("p", 1, won)] and store.versions("t") == [1, 2]
    assert not [f for f in os.listdir(tmp_path / "t" / "manifests") if f.endswith(".tmp")]
    assert store.vacuum("t") == 1 and seen(store) == [("p", 1, won)]  # the loser's files


def test_table_without_projects(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert not store.exists("t")
    store.upsert("t", spark.createDataFrame([(1, "a")], "id long, v string"), ["id"])
    store.upsert("t", spark.createDataFrame([(1, "b"), (2, "c")], "id long, v string"), ["id"])
    assert sorted((r.id, r.v) for r in store.read("t").collect()) == [(1, "b"), (2, "c")]
    store.delete(["t"], id=1)
    assert [r.v for r in store.read("t").collect()] == ["c"]
