"""Parsed files, stored tables, the stream over a folder, and whole flows on small tables."""

import io
import zipfile

from pyspark.sql import functions as F

from parchment.functions import naming
from parchment.plans import advice, drafting
from parchment.sources.files import parse, scan, thin
from parchment.sources.store import Store
from parchment.streaming.refresh import refresh

DOCX = (
    '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a  b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
)
MAIL = b"From: a@x\nTo: b@x\nSubject: s\nMIME-Version: 1.0\nContent-Type: text/html; charset=utf-8\n\n<p>Hello&nbsp;you</p>"


def docx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", DOCX)
    return out.getvalue()


def test_formats(spark):
    rows = [("/x/a.DOCX", docx()), ("/x/b.eml", MAIL), ("/x/c.txt", "﻿a\r\nb".encode()), ("/x/d.pdf", b"%PDF"), ("/x/e.docx", b"no zip"), ("/x/noext", b"q")]
    got = {r.file_name: r for r in parse(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.DOCX"].text_content == "One\na b | c"
    assert got["b.eml"].text_content.startswith("From: a@x\nTo: b@x\nSubject: s") and got["b.eml"].text_content.endswith("Hello you")
    assert got["c.txt"].text_content == "a\nb" and got["noext"].text_content == "q"
    assert [got[n].parse_status for n in ("d.pdf", "e.docx")] == ["FAILED", "FAILED"]


def test_plugins(spark):
    got = parse(spark.createDataFrame([("/x/d.pdf", b"%PDF")], "path string, content binary"), {"pdf": lambda b: "page"}).first()
    assert (got.parse_status, got.text_content) == ("PARSED", "page")


def test_thin(spark):
    pages = spark.createDataFrame([(1, 1, "x" * 100), (2, 1, "a"), (2, 2, None)], "doc_id long, page_no int, text string")
    assert {r.doc_id: r.thin for r in thin(pages).collect()} == {1: False, 2: True}


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.write("t", spark.createDataFrame([("p", 1, "a"), ("q", 2, "b")], "project_id string, id long, v string"))
    store.upsert("t", spark.createDataFrame([("p", 1, "z"), ("p", 3, "c")], "project_id string, id long, v string"), ["id"])
    assert sorted((r.id, r.v) for r in store.read("t").collect()) == [(1, "z"), (2, "b"), (3, "c")]
    store.delete(["t", "none"], project_id="p")
    store.prune("t")
    assert [r.id for r in store.read("t").collect()] == [2]
    assert store.versions("t") == [2, 3] and sorted(p.name for p in (tmp_path / "t").iterdir()) == ["data", "manifests"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    store = Store(spark, f"file://{tmp_path}/store")
    for said in ("one", "two"):
        (tmp_path / f"in/{said}.txt").write_text(said)
        refresh(spark, f"file://{tmp_path}/in", store, f"file://{tmp_path}/cp").awaitTermination(60)
    assert sorted(r.text_content for r in store.read("source_document").collect()) == ["one", "one", "two"]
    assert scan(spark, f"file://{tmp_path}/in").count() == 3


def test_ask(spark):
    docs = spark.createDataFrame([("p", 1, "NTT", "n.txt", 3, "SCC 4.1 pays monthly."), ("q", 2, None, None, 1, " ")], "project_id string, id long, file_key string, file_name string, page_count int, text_content string")
    index = advice.rebuild_index(docs)
    row = index.first()
    assert (row.chunk_index, row.page_no, row.anchor, row.file_label, row.point_id) == (0, "P3", "SCC 4.1", "NTT · n.txt", "1-0")
    asked = spark.createDataFrame([("p", "when?"), ("q", "what?"), ("p", " ")], "project_id string, question string")
    chat = lambda p: '{"grounded": true, "answer": "monthly", "citations": []}'
    got = {(r.project_id, r.question): r for r in advice.ask(asked, index, chat).collect()}
    first = got["p", "when?"]
    assert first.answer == "monthly" and first.citations == ["NTT · n.txt"] and first.evidence_id == "chunk:NTT · n.txt" and first.sources[0].page_no == "P3" and first.error is None
    assert got["q", "what?"].error == 4204 and got["p", ""].error == 4202 and got["p", ""].grounded is None and got["p", ""].citations is None

    def down(prompt):
        raise OSError("down")

    assert [r.error for r in advice.ask(asked.limit(1), index, down).collect()] == [4203]
    unsure = lambda p: '{"grounded": false, "missingReason": "not said"}'
    r = advice.ask(asked.limit(1), index, unsure).first()
    assert (r.grounded, r.title, r.unknown_scope, r.citations, r.answer) == (False, "I don't know", "fullset", ["NTT · n.txt", "not said"], None)


def test_ask_without_hits(spark):
    """A project whose chunks are too many to send whole, and none near the question: the model isn't asked."""
    docs = spark.createDataFrame([("p", 1, "NTT", "n.txt", 3, "words " * 20_000)], "project_id string, id long, file_key string, file_name string, page_count int, text_content string")
    index = advice.rebuild_index(docs).withColumn("embedding", F.transform("embedding", lambda x: F.lit(0.0).cast("float")))

    def chat(prompt):
        raise AssertionError("asked")

    r = advice.ask(spark.createDataFrame([("p", "what?")], "project_id string, question string"), index, chat).first()
    assert (r.grounded, r.citations, r.sources, r.evidence_id, r.error) == (False, [advice.NOTHING], [], None, None)


def test_reconcile(spark):
    schema = "project_id string, pos long, key string, scope string, file_key string, label string, action string, options array<string>, affects string, value string, source string, confidence double"
    said = [
        ("p", 1, "worksType", "BASE", None, "x", None, None, None, "roads", None, 0.1),
        ("p", 2, "own key!", "FILE", "ntt", "x", "fill", None, "ntt, zz", "v", None, None),
        ("p", 3, "unsure", "FILE", None, "x", "fill", None, None, "v", None, 0.5),
        ("p", 4, "invented", "BASE", None, "x", "fill", None, None, "v", None, 0.9),
        ("p", 5, "twoEnvelopeSystem", "BASE", None, "x", None, None, None, "yes", None, 0.9),
        ("p", 6, "locked", "FILE", None, "x", "fill", None, None, "new", None, 0.9),
    ]
    stored = spark.createDataFrame([("p", "locked", True, "old", "FILE"), ("p", "gone", False, "old", "FILE"), ("p", "billNos", False, "old", "BASE")], "project_id string, var_key string, confirmed boolean, value_text string, scope string")
    for c in drafting.VALUES:
        if c not in stored.columns:
            stored = stored.withColumn(c, F.lit(None).cast("int" if c == "sort_order" else "string"))
    got = {r.var_key: r for r in drafting.reconcile(spark.createDataFrame(said, schema), stored).collect()}
    assert sorted(got) == sorted([*(k for k, *_ in naming.BASE_VARIABLES), "locked", "ownkey"])
    assert got["locked"].value_text == "old" and got["ownkey"].affects == "NTT" and got["ownkey"].sort_order == 1000
    assert got["twoEnvelopeSystem"].choice == "是" and got["worksType"].sort_order == 1
