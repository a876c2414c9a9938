"""Files that keep coming into a folder: parsed as they arrive, upserted into a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from parchment.sources.files import parse
from parchment.sources.store import Store

BINARY = "path string, modificationTime timestamp, length long, content binary"


def refresh(spark: SparkSession, folder: str, store: Store, checkpoint: str, name: str = "source_document", trigger: dict | None = None) -> StreamingQuery:
    """A stream over the folder; each batch replaces rows of the same path, so that a batch may run twice. Of the table's
    snapshots the last two stay."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(folder)

    def each(batch: DataFrame, _: int) -> None:
        store.upsert(name, parse(batch.select("path", "content")), ["path"])
        store.prune(name)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
