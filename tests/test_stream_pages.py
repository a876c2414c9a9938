"""Pages that come late, in any order, twice, or never."""

import json
import time

from parchment.sources.store import Store
from parchment.streaming.pages import EVENTS, to_store

LONG = "words that fill the page with more than forty characters of text"


class Feed:
    def __init__(self, spark, tmp_path, **limits):
        (tmp_path / "in").mkdir()
        self.spark, self.at, self.limits, self.n = spark, tmp_path, limits, 0
        self.store = Store(spark, f"file://{tmp_path}/store")

    def send(self, *events):
        self.n += 1
        lines = "\n".join(json.dumps(dict(zip(("doc_id", "kind", "page_no", "pages", "text"), e))) for e in events)
        (self.at / "in" / f"{self.n}.json").write_text(lines)
        stream = self.spark.readStream.schema(EVENTS).json(f"file://{self.at}/in")
        parts = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", "1")
        try:
            assert to_store(self.spark, stream, self.store, f"file://{self.at}/cp", **self.limits).awaitTermination(300)
        finally:
            self.spark.conf.set("spark.sql.shuffle.partitions", parts)
        if not self.store.exists("source_text"):
            return {}
        return {r.doc_id: (r.text_content, r.page_count, r.ocr_used, r.complete, r.parse_status) for r in self.store.read("source_text").collect()}


def test_late_pages(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    assert feed.send((1, "page", 2, None, LONG + " two"), (2, "document", None, 2, None), (2, "page", 1, None, " "), (None, "page", 1, None, "x"), (3, "odd", 1, 1, "x")) == {}
    got = feed.send((1, "document", None, 2, None), (1, "page", 1, None, LONG), (2, "page", 2, None, "a"), (2, "recognised", 1, None, "read one"))
    assert got == {1: (f"--- P1 ---\n{LONG}\n\n--- P2 ---\n{LONG} two", 2, False, True, "PARSED")}  # 2 is thin and waits for an image
    late = [(2, "recognised", 2, None, "read two"), (2, "recognised", 2, None, "read two"), (1, "page", 1, None, "too late"), (4, "document", None, 0, None)]
    got = feed.send(*late)
    assert got[2] == ("--- P1 ---\nread one\n\n--- P2 ---\nread two", 2, True, True, "PARSED") and got[1][0].startswith(f"--- P1 ---\n{LONG}")
    assert set(got) == {1, 2, 4} and got[4] == ("", 0, False, True, "FAILED")


def test_time_runs_out(spark, tmp_path):
    feed = Feed(spark, tmp_path, wait_ms=1)
    assert feed.send((1, "document", None, 3, None), (1, "page", 2, None, LONG), (2, "page", 1, None, " ")) == {}
    time.sleep(0.1)
    got = feed.send((9, "document", None, 1, None), (9, "page", 1, None, LONG))
    assert got[1] == (f"--- P2 ---\n{LONG}", 3, False, False, "PARSED") and got[2] == ("", 1, False, False, "FAILED")
    assert got[9][3]
