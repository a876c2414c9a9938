"""Bytes that executors write, read and delete; deletion of a project or a document with all that hangs on it."""

import os

import pytest
from pyspark.sql import functions as F

from parchment.sources import blobs
from parchment.sources.cascade import PENDING, Cascade, Key
from parchment.sources.store import Store


def on_disk(root) -> list[str]:
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.startswith("."))


def test_bytes(spark, tmp_path):
    root = f"file://{tmp_path}/files"
    rows = [("p", "PROJECT_INPUT", "a b.txt", b"one"), ("p", "PROJECT_INPUT", "a b.txt", b"two"), ("p", "STANDARD_TEMPLATE", 'c:"d".pdf', b""), ("q é", "PROJECT_INPUT", None, b"x" * 100_000), ("..", "PROJECT_INPUT", "e", b"no"), ("p", "a/b", "f", b"no"), (None, "PROJECT_INPUT", "g", b"no"), ("p", "PROJECT_INPUT", "h", None)]
    df = spark.createDataFrame(rows, "project_id string, category string, file_name string, content binary").repartition(3)
    first = {(r.project_id, r.category, r.file_name, r.length): (r.storage_path, r.error) for r in blobs.write(df, root).collect()}
    once = on_disk(tmp_path / "files")
    assert len(once) == 4 and not [x for d, _, fs in os.walk(tmp_path) for x in fs if x.startswith(".") and not x.endswith(".crc")]
    again = {(r.project_id, r.category, r.file_name, r.length): (r.storage_path, r.error) for r in blobs.write(df, root).collect()}
    assert again == first and on_disk(tmp_path / "files") == once  # a rerun leaves one file each
    assert sorted(e for _, e in first.values() if e) == ["no content", *["no folder of that name"] * 3]
    own = blobs.read(spark, root, ["p"], ["PROJECT_INPUT"])
    assert sorted((r.file_name, bytes(r.content), r.project_id) for r in own.collect()) == [("a b.txt", b"one", "p"), ("a b.txt", b"two", "p")]
    assert sorted((r.project_id, r.length) for r in blobs.read(spark, root).collect()) == [("p", 3), ("p", 3), ("q é", 100_000)]  # not the empty one
    assert blobs.read(spark, root, ["absent"]).collect() == []
    assert "STANDARD_TEMPLATE" not in "".join(own.inputFiles())  # other folders aren't listed
    paths = blobs.write(df, root).where("error IS NULL").select("storage_path")
    assert sorted(r.deleted for r in blobs.delete(paths.unionByName(paths)).collect()) == [True] * 4 and on_disk(tmp_path / "files") == []
    assert {(r.deleted, r.error) for r in blobs.delete(spark.createDataFrame([(f"{root}/p/none",), (None,)], "storage_path string")).collect()} == {(False, None)}


def filled(spark, tmp_path) -> Store:
    store = Store(spark, f"file://{tmp_path}/store")
    store.write("project", spark.createDataFrame([("p",), ("q",)], "id string").withColumn("project_id", F.col("id")))
    files = spark.createDataFrame([(p, "PROJECT_INPUT", f"{p}{i}.txt", f"{p}{i}".encode(), 10 * (p == "q") + i) for p in "pq" for i in range(3)], "project_id string, category string, file_name string, content binary, id long")
    written = blobs.write(files, f"file://{tmp_path}/files")
    store.write("source_document", written.select("project_id", "id", "storage_path"))
    chunks = spark.createDataFrame([(p, 100 * d + k, d) for p, ds in (("p", (0, 1, 2)), ("q", (10, 11, 12))) for d in ds for k in range(4)], "project_id string, id long, document_id long")
    store.write("evidence_chunk", chunks)
    store.write("evidence_vector", chunks.select("project_id", F.concat("document_id", F.lit("-"), "id").alias("id"), "document_id"))
    store.write("chat_message", spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "project_id string, id long").withColumn("id", F.concat("project_id", "id")))
    return store


def test_a_document_goes(spark, tmp_path):
    store = filled(spark, tmp_path)
    cascade = Cascade(store)
    got = cascade.delete("source_document", spark.createDataFrame([(1,)], "id long"))
    assert got == {"source_document": 1, "evidence_chunk": 4, "evidence_vector": 4, "files": 1}
    assert not any(cascade.orphans().values()) and len(on_disk(tmp_path / "files")) == 5
    assert store.read("evidence_chunk").count() == 20 and store.read("chat_message").count() == 3


def test_a_project_goes(spark, tmp_path):
    """One call; nothing refers to what is gone, other projects are as they were."""
    store = filled(spark, tmp_path)
    cascade = Cascade(store)
    others = {t: sorted(map(str, store.read(t).where("project_id = 'q'").collect())) for t in ("project", "source_document", "evidence_chunk", "evidence_vector", "chat_message")}
    got = cascade.delete("project", spark.createDataFrame([("p",), ("none",)], "id string"))
    assert got == {"project": 1, "source_document": 3, "evidence_chunk": 12, "evidence_vector": 12, "chat_message": 2, "files": 3}
    assert {t: sorted(map(str, store.read(t).collect())) for t in others} == others
    assert set(cascade.orphans().values()) == {0} and [x.split("_")[-1] for x in on_disk(tmp_path / "files")] and len(on_disk(tmp_path / "files")) == 3
    assert cascade.delete("project", spark.createDataFrame([("p",)], "id string"))["files"] == 0


def test_a_run_that_dies(spark, tmp_path):
    """Rows are gone, files are not: they are noted, and the next run deletes them."""
    store = filled(spark, tmp_path)

    class Dies(Cascade):
        def finish(self, spark):
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        Dies(store).delete("project", spark.createDataFrame([("p",)], "id string"))
    assert len(on_disk(tmp_path / "files")) == 6 and store.read(PENDING).count() == 3
    assert Cascade(store).finish(spark) == 3 and len(on_disk(tmp_path / "files")) == 3 and store.read(PENDING).count() == 0


def test_circle(spark, tmp_path):
    with pytest.raises(ValueError):
        Cascade(Store(spark, f"file://{tmp_path}"), [Key("a", "x", "b"), Key("b", "y", "a")]).delete("a", spark.createDataFrame([(1,)], "id long"))
