"""Files that people send, on small tables; and the chat client's retries."""

import io
import json
import urllib.error

import pytest

from parchment.operators import providers
from parchment.plans import upload

FILES = "project_id string, pos int, file_name string, content binary"


def docs(spark, rows):
    return spark.createDataFrame(rows, "project_id string, id long, category string, file_key string, file_name string, parse_status string, text_content string")


def test_templates(spark):
    files = spark.createDataFrame(
        [
            ("p", 1, "NTT a.txt", b"one"),
            ("p", 2, "ntt b.pdf", b"%PDF"),  # no parser: the text of the one before stays
            ("p", 3, "empty sct.txt", b""),
            ("p", 4, "contract.txt", b"own"),
            ("p", 5, "contract.txt", b"own"),
            ("q", 1, "ntt.txt", b"new"),
            ("q", 2, "ntt 2.txt", b"newer"),
        ],
        FILES,
    )
    held = docs(spark, [("p", 3, upload.TEMPLATE, "NTT", "old", "PARSED", "old"), ("p", 4, upload.TEMPLATE, "NTT", "later", "PARSED", "later"), ("p", 5, upload.PACKAGE, "SCC", "s", "PARSED", "s")])
    said = upload.received(files, upload.TEMPLATE, "root")
    got = {(r.project_id, r.id): r for r in upload.templates(held, said).collect()}
    assert sorted(got) == [("p", 3), ("p", 4), ("p", 5), ("p", 6), ("p", 7), ("q", 1)]
    assert (got["p", 3].file_name, got["p", 3].parse_status, got["p", 3].text_content) == ("ntt b.pdf", "FAILED", "one")
    assert got["p", 4].text_content == "later" and got["p", 5].text_content == "s"
    assert got["p", 6].file_key == "SCC" and got["p", 7].text_content == "own"
    assert got["q", 1].text_content == "newer" and got["q", 1].size_bytes == 5
    assert {r.project_id: r[1:] for r in upload.result(files, said).collect()} == {"p": (5, 3, 1), "q": (2, 2, 0)}


def test_replacing_forgets_the_old_text(spark):
    held = docs(spark, [("p", 3, upload.TEMPLATE, "SCT", "old", "PARSED", "old")])
    said = upload.received(spark.createDataFrame([("p", 1, "any.pdf", b"%PDF")], FILES), upload.TEMPLATE, "root", file_key="SCT")
    row = upload.templates(held, said, fresh=True).first()
    assert (row.id, row.parse_status, row.text_content or "") == (3, "FAILED", "")
    with pytest.raises(ValueError, match="4009"):
        upload.received(held, upload.TEMPLATE, "root", file_key="GCC")


def test_inputs_and_packages(spark):
    files = spark.createDataFrame([("p", 1, "a.txt", b"x"), ("p", 2, "gcc v2.txt", b"y"), ("p", 3, None, b"z"), ("p", 4, "n.txt", None)], FILES)
    held = docs(spark, [])
    inputs = upload.added(held, upload.received(files, upload.INPUT, "root")).orderBy("id").collect()
    assert [(r.id, r.file_key, r.text_content) for r in inputs] == [(1, None, "x"), (2, None, "y"), (3, None, "z")]
    package = upload.added(held, upload.received(files, upload.PACKAGE, "root")).orderBy("id").collect()
    assert [r.file_key for r in package] == [None, "GCC", None]
    assert inputs[0].storage_path.startswith("root/p/PROJECT_INPUT/") and inputs[0].storage_path.endswith("_a.txt")


def test_chat_tries_broken_connections_again(monkeypatch):
    asked = []

    def urlopen(request, timeout):
        asked.append(json.loads(request.data)["messages"][0]["content"])
        if len(asked) == 1:
            raise OSError("broken")
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": "said"}}]}).encode())

    monkeypatch.setattr(providers.urllib.request, "urlopen", urlopen)
    assert providers.http_chat("http://x", "m")("hello") == "said" and asked == ["hello", "hello"]

    def refused(request, timeout):
        asked.append("refused")
        raise urllib.error.HTTPError("http://x", 400, "no", {}, None)

    monkeypatch.setattr(providers.urllib.request, "urlopen", refused)
    with pytest.raises(urllib.error.HTTPError):
        providers.http_chat("http://x", "m")("hello")
    assert asked[2:] == ["refused"]
