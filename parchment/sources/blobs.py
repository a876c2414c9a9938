"""Files' bytes, kept below {root}/{project}/{category}/{hash}_{name}: written, read and deleted by the executors.

A name begins with eight hex digits of the content's digest, so the same file has the same name however often a task runs. Bytes go to a
hidden name first and get their own by a rename: a reader never sees half a file, and a task that dies leaves a hidden one that scans
skip. Any store that pyarrow knows by its URI will do (file, hdfs, s3, gs). Reading is Spark's binaryFile scan over the folders of what is asked for.

A project or category that can't be a folder's name (null, blank, with a slash, or only dots) is an error in its row, as is a null
content; nothing is written for it. Equal files of one project and category are one file. Empty files are written, but Spark's scan
leaves them out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions.text import is_blank, stored_path


def _folder(c: Column) -> Column:
    return ~is_blank(c) & ~c.rlike(r"[/\\]|^\.+$")


def _store(uri: str):
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@')}") if mark else (fs.LocalFileSystem(), uri)


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        errors = []
        for path, content, error in zip(rows.storage_path, rows.content, rows.error):
            if not error:
                try:
                    at, name = _store(path)
                    folder, _, own = name.rpartition("/")
                    draft = f"{folder}/.{own[:64]}.{uuid.uuid4().hex}"
                    at.create_dir(folder, recursive=True)
                    with at.open_output_stream(draft) as out:
                        out.write(bytes(content))
                    at.move(draft, name)
                except OSError as e:  # the row says so; the others are written
                    error = f"{type(e).__name__}: {e}"[:300]
            errors.append(error or None)
        yield rows.drop(columns="content").assign(error=errors)


def write(rows: DataFrame, root: str) -> DataFrame:
    """rows (project_id, category, file_name, content and others) without their content, with storage_path, length and error (null where
    the file is there). The result has to be written or stored: files are written as it is computed, once more if it is again."""
    path = stored_path(root, F.col("project_id").cast("string"), F.col("category"), F.col("file_name"), F.col("content"))
    bad = F.when(F.col("content").isNull(), "no content").when(~(_folder(F.col("project_id").cast("string")) & _folder(F.col("category"))), "no folder of that name")
    kept = [c for c in rows.columns if c != "content"]
    made = rows.select(*kept, F.when(bad.isNull(), path).alias("storage_path"), F.length("content").cast("long").alias("length"), bad.alias("error"), "content")
    schema = made.drop("content").schema
    return made.mapInPandas(_written, schema)


def read(spark: SparkSession, root: str, projects: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """path, length, content of stored files, project_id, category and file_name from their paths. Only the folders asked for are listed."""
    escaped = lambda xs: [("".join(f"\\{c}" if c in "{}[]*?\\," else c for c in x)) for x in xs] if xs is not None else ["*"]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = []
    for p in escaped(projects):
        for c in escaped(categories):
            at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{p}/{c}")
            folders += [s.getPath().toString() for s in at.getFileSystem(conf).globStatus(at) or [] if s.isDirectory()]
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").load(folders) if folders else spark.createDataFrame([], schema)
    part = lambda n: F.url_decode(F.replace(F.element_at(F.split("path", "/"), n), F.lit("+"), F.lit("%2B")))
    return files.select("path", "length", "content", part(-3).alias("project_id"), part(-2).alias("category"), F.regexp_replace(part(-1), "^[0-9a-f]{8}_", "").alias("file_name"))


def _deleted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        gone, errors = [], []
        for path in rows.storage_path:
            done, error = False, None
            try:
                at, name = _store(path)
                at.delete_file(name)
                done = True
            except FileNotFoundError:
                pass
            except OSError as e:
                error = f"{type(e).__name__}: {e}"[:300]
            gone.append(done)
            errors.append(error)
        yield pd.DataFrame({"storage_path": rows.storage_path, "deleted": gone, "error": errors})


def delete(paths: DataFrame) -> DataFrame:
    """storage_path, deleted, error for each distinct path: a file that isn't there is no error."""
    wanted = paths.where(~is_blank(F.col("storage_path"))).select("storage_path").distinct()
    return wanted.mapInPandas(_deleted, "storage_path string, deleted boolean, error string")
