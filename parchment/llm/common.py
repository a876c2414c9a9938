"""What the training-data operators share: tables, words, tables in the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.sources.scratch import among, apart, forget, parts_for, quoted, scratch, shared_dir, small_batches, stored  # noqa: F401

#: A word is a run of anything but ASCII white space; in Python ``bytes.split()`` gives the same words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # a C library without it
        return lambda _: 0


_TRIM = _trim()


def release(trim: bool = True) -> None:
    """Give what Arrow and, trim, numpy and Python have freed back to the system: an executor's Python workers live on beside later stages."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
    if trim:
        _TRIM(0)


def parts(texts: pa.Array, rows: int = 512, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Start and length of runs of a batch: up to `rows` texts of up to `size` bytes together, or one longer text."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and (i - start == rows or held + (n or 0) > size):
            yield start, i - start
            start, held = i, 0
        held += n or 0
    if len(texts):
        yield start, len(texts) - start
    release()


def plainly(df: DataFrame, source: str, adds: dict[str, T.DataType], over: Callable[[Iterator[pa.RecordBatch], list[str], str], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df with the columns `adds`, which over(batches, columns to keep, column to read) gives in an Arrow stage. Columns of these names
    are replaced. Names that Arrow stages can't take, with dots or backticks, are put back afterwards."""
    small_batches(df.sparkSession)
    gone = {a.lower() for a in adds}
    kept = [c for c in df.columns if c.lower() not in gone]
    names = [f"c{i}" for i in range(len(kept))]
    read = next((n for n, c in zip(names, kept) if c == source), "read")
    inner = df.select(*[quoted(c).alias(n) for c, n in zip(kept, names)], *[quoted(source).alias(read)] * (read == "read"))
    schema = T.StructType([*inner.schema.fields[: len(kept)], *[T.StructField(n, t) for n, t in adds.items()]])
    return inner.mapInArrow(lambda batches: over(batches, names, read), schema).toDF(*kept, *adds)
