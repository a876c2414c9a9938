"""Documents whose pages come in one by one: state by document waits for them, and for what is recognised on their images.

Events are (doc_id, kind, page_no, pages, text): one `document` says how many pages there are, a `page` brings a page's own text, a
`recognised` what was read on its image; in any order, and again if they are sent twice. A document is complete once all its pages
are there and, where their text is thin (fewer characters than `least` a page), something recognised for each of them (for the
first `most` of them: no more images are read). It comes out once, when it is complete or when `wait` has gone by since
its first event; what arrives later is dropped. Only texts of documents that are under way are kept, in the state store, which a
lost executor's successor reads from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parchment.functions.text import is_blank, join_pages, normalize
from parchment.sources.scratch import forget, stored
from parchment.sources.store import Store

EVENTS = "doc_id long, kind string, page_no int, pages int, text string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_OUT = "doc_id long, pages array<struct<page_no:int,text:string>>, page_count int, ocr_used boolean, thin boolean, complete boolean"


class Gather(StatefulProcessor):
    def __init__(self, wait_ms: int, least: int, most: int):
        self.wait_ms, self.least, self.most = wait_ms, least, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getMapState("own", "page_no int", "text string, size int")
        self.seen = handle.getMapState("seen", "page_no int", "text string")
        self.head = handle.getValueState("head", "expected int, done boolean, until long")

    def _emit(self, key, expected: int | None, complete: bool) -> pd.DataFrame:
        own = {k[0]: v for k, v in self.own.iterator()}
        seen = {k[0]: v[0] for k, v in self.seen.iterator()}
        thin = sum(v[1] for v in own.values()) < self.least * max(1, len(own))
        told = {n: own[n][0] for n in own} | ({n: t for n, t in seen.items() if t} if thin else {})
        pages = [{"page_no": int(n), "text": told[n]} for n in sorted(told)]
        used = thin and any(seen.values())
        self.own.clear()
        self.seen.clear()
        return pd.DataFrame({"doc_id": [key[0]], "pages": [pages], "page_count": [expected if expected is not None else len(own)], "ocr_used": [used], "thin": [thin], "complete": [complete]})

    def _complete(self, expected: int | None) -> bool:
        if expected is None:
            return False
        own = {k[0]: v[1] for k, v in self.own.iterator()}
        if len(own) < expected:
            return False
        if sum(own.values()) >= self.least * max(1, expected):
            return True
        return sum(1 for _ in self.seen.iterator()) >= min(expected, self.most)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expected, done, until = self.head.get() if self.head.exists() else (None, False, None)
        if done:
            return
        if until is None:
            until = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
            self.handle.registerTimer(until)
        for batch in rows:
            for kind, page, pages, text, size in zip(batch["kind"], batch["page_no"], batch["pages"], batch["text"], batch["size"]):
                if kind == "document":
                    expected = int(pages)
                elif kind == "page":
                    self.own.updateValue((int(page),), (text, int(size)))
                elif kind == "recognised":
                    self.seen.updateValue((int(page),), (text,))
        done = self._complete(expected)
        self.head.update((expected, done, until))
        if done:
            self.handle.deleteTimer(until)
            yield self._emit(key, expected, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expected, done, until = self.head.get()
        if not done:
            self.head.update((expected, True, until))
            yield self._emit(key, expected, False)


def gather(events: DataFrame, wait_ms: int = 3_600_000, least: int = 40, most: int = 60) -> DataFrame:
    """A stream of EVENTS as a stream of documents: doc_id, text_content (pages joined under their marks), page_count, ocr_used,
    complete, parse_status (FAILED where a thin document has no text at all)."""
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    told = F.when(F.col("kind") != "document", normalize(F.col("text")))
    sent = events.where("doc_id IS NOT NULL AND (pages >= 0 AND kind = 'document' OR page_no IS NOT NULL AND kind IN ('page', 'recognised'))")
    sent = sent.select("doc_id", "kind", F.coalesce("page_no", F.lit(0)).alias("page_no"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce(told, F.lit("")).alias("text"), F.coalesce(F.length(told), F.lit(0)).alias("size"))
    done = sent.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Gather(wait_ms, least, most), outputStructType=_OUT, outputMode="Append", timeMode="ProcessingTime")
    said = done.withColumn("text_content", join_pages(F.col("pages")))
    failed = F.col("thin") & is_blank(F.col("text_content"))
    return said.select("doc_id", "text_content", "page_count", "ocr_used", "complete", F.when(failed, "FAILED").otherwise("PARSED").alias("parse_status"))


def to_store(spark: SparkSession, events: DataFrame, store: Store, checkpoint: str, name: str = "source_text", trigger: dict | None = None, **limits: int) -> StreamingQuery:
    """gather() into a stored table; a batch that runs twice replaces its own rows. A trigger that takes what is there and ends runs
    batches with events only (with timers under way Spark would go on for ever): there, waiting ends with the next events."""
    spark_conf, ends = spark.conf, trigger is None or not {"processingTime", "continuous"} & set(trigger)

    def each(batch: DataFrame, _: int) -> None:
        rows = stored(batch, "gathered")  # once: state must not be asked twice
        if not rows.isEmpty():
            store.upsert(name, rows, ["doc_id"])
            store.prune(name)
        forget(rows)

    writer = gather(events, **limits).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    held = spark_conf.get(IDLE)
    spark_conf.set(IDLE, str(not ends and held == "true").lower())
    try:
        return writer.start()  # takes the settings of now
    finally:
        spark_conf.set(IDLE, held)
