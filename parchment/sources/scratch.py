"""Tables that a plan writes to read them more than once, below spark.checkpoint.dir, which driver and executors share; and
what keeps rows from a shuffle that no join will find."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary
    one; a cluster has no folder of that kind, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Tables that stored() wrote in each scratch() that is open.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are stored inside are deleted at the end: what is made of them has to be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for df in _OPEN.pop():
            forget(df)


def stored(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage and survives lost executors. keep: the scratch()
    around this one, if any, deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    if len(_OPEN) > keep:
        _OPEN[-1 - keep].append(found)
    return found


def delete_path(spark: SparkSession, path: str) -> bool:
    """A file or a folder with all that is in it, through Hadoop's file systems; whether it was there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def forget(df: DataFrame) -> None:
    """Delete the files of a stored() table that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_path(df.sparkSession, folder)


def quoted(name: str) -> Column:
    """A column of any name, with dots or backticks too."""
    return F.col("`" + name.replace("`", "``") + "`")


def apart(df: DataFrame, outputs: Iterable[str] = ()) -> tuple[list[str], Callable[[str], str]]:
    """The columns of df that stay beside an operator's outputs, quoted, and names for its own columns that none of them has."""
    gone, mark = {o.lower() for o in outputs}, "_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return ["`" + c.replace("`", "``") + "`" for c in df.columns if c.lower() not in gone], lambda name: mark + name


#: Bits of the largest map that among() broadcasts: 32 MB.
MAP_BITS = 28


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows whose key, a long, is among ids (one column, a stored table, without nulls), and a few others: what a join on the key needs, so that
    other rows are not shuffled. Hashed ids set bits of a map, 16 bits for each id and MAP_BITS at most, in pieces of 4 kB that
    are broadcast. Beyond an id a bit the map would tell little, and all rows stay."""
    n = ids.count()
    bits = min(max(15, (n * 16).bit_length()), MAP_BITS)
    if n > 1 << bits:
        return rows
    own = apart(rows)[1]
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << bits))
    at, of = place(F.col(key)), place(F.col(ids.columns[0]))
    pieces = ids.groupBy(F.shiftright(of, 15).alias(own("piece"))).agg(F.bitmap_construct_agg(of.bitwiseAND(F.lit(32767))).alias(own("map")))
    byte = F.substring(F.col(own("map")), F.shiftright(at.bitwiseAND(F.lit(32767)), 3).cast("int") + 1, F.lit(1))
    found = rows.join(F.broadcast(pieces), F.shiftright(at, 15) == F.col(own("piece")))
    hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), at.bitwiseAND(F.lit(7)).cast("int")) == 1
    return found.where(hit).select(*apart(rows)[0])


def sent(rows: DataFrame, to: DataFrame, at: list[str]) -> DataFrame:
    """rows whose columns `at` a stored table has, and a few others: texts of no use to a join stay where they are."""
    hashed = lambda df: df.select("*", F.xxhash64(*at).alias("_at"))
    return among(hashed(rows), "_at", hashed(to).select("_at")).drop("_at")


def parts_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes of a batch between the JVM and Python, where the session doesn't say.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Texts are long: ten thousand of them, Spark's default, are a batch of 25 MB and more, held several times over by both sides."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
