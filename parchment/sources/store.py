"""Tables under manifests: a version is a list of files, and a change writes only the files of the projects that it touches.

Files lie in {root}/{table}/data/{write}/project_id=.../ and are never changed. A manifest, {root}/{table}/manifests/{version}.json,
names the columns and lists, for each project, the folders that hold its rows, newest last, and what was deleted since a folder was written (tombstones:
equality on columns). It is created under a temporary name and moved to its place with a rename that fails if the name is taken,
so of two writers that start from one version the second gets a Conflict, and readers see a version whole or not at all.
(On an object store without such a rename, writers of one table have to take turns.) An upsert
rewrites the touched projects; append() and delete() add a folder or a tombstone; compact() folds both into new files. vacuum() deletes folders that no
kept manifest lists. Nothing depends on the order of jobs: a write that dies leaves files that no manifest lists.

A manifest grows with the number of projects; it is read on the driver. A table without project_id has one project, null.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another writer has taken the version."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: str = ""
    #: project as JSON text (null for none) -> folders of data, oldest first
    folders: dict[str, list[str]] = field(default_factory=dict)
    #: number of the version, columns and values that rows of older folders had to go for
    tombstones: list[dict] = field(default_factory=list)
    #: folder -> version that added it
    born: dict[str, int] = field(default_factory=dict)

    def listed(self) -> set[str]:
        return {f for fs in self.folders.values() for f in fs}


def _text(project) -> str:
    return json.dumps(project, ensure_ascii=False, default=str)


class Store:
    """Versions of named tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(self.conf)

    # ---- manifests

    def versions(self, name: str) -> list[int]:
        folder = self.path(f"{self.root}/{name}/manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def manifest(self, name: str, version: int | None = None) -> Manifest:
        known = self.versions(name)
        if not known:
            return Manifest()
        at = known[-1] if version is None else version
        said = self.spark.read.option("wholetext", True).text(f"{self.root}/{name}/manifests/{at:012d}.json").first()[0]
        return Manifest(**json.loads(said))

    def _commit(self, name: str, made: Manifest) -> None:
        """The manifest under its version's name, which must be free."""
        folder = f"{self.root}/{name}/manifests"
        self.fs.mkdirs(self.path(folder))
        at, draft = self.path(f"{folder}/{made.version:012d}.json"), self.path(f"{folder}/.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(made.__dict__, ensure_ascii=False).encode()))
        out.close()
        try:
            self._take(draft, at)
        except Exception as e:
            if self.fs.exists(at):
                raise Conflict(f"{name}: version {made.version} is taken") from e
            raise
        finally:
            self.fs.delete(draft, False)

    def _take(self, draft, at) -> None:
        """draft under the name `at`, which fails if that is taken, in one step for all writers."""
        if self.fs.getUri().getScheme() == "file":  # a second name for the file: the system has no rename that fails on a taken one
            os.link(draft.toUri().getPath(), at.toUri().getPath())
            return
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(draft, at, none)  # without OVERWRITE

    # ---- reading

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default: of each folder those that no later tombstone took."""
        m = self.manifest(name, version)
        return self._rows(name, m, sorted(m.folders))

    def _rows(self, name: str, m: Manifest, projects: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(m.schema))
        found: DataFrame | None = None
        by_age: dict[int, list[str]] = {}
        for p in projects:
            for folder in m.folders.get(p, []):
                # folders of one age meet the same tombstones
                by_age.setdefault(sum(t["version"] > m.born[folder] for t in m.tombstones), []).append(folder)
        for later, folders in sorted(by_age.items()):
            rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/data/{f}" for f in folders])
            for t in m.tombstones[len(m.tombstones) - later :] if later else []:
                gone = F.lit(True)
                for column, value in t["equal"].items():
                    gone = gone & F.coalesce(F.col(column) == value, F.lit(False))
                rows = rows.where(~gone)
            found = rows if found is None else found.unionByName(rows)
        return self.spark.createDataFrame([], schema) if found is None else found

    # ---- writing

    def _written(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Rows as new files, a folder for each project: project -> folder. Each project's rows are spread over 16 tasks at most."""
        write = uuid.uuid4().hex
        at = f"{self.root}/{name}/data/{write}"
        if "project_id" not in rows.columns:
            rows.write.parquet(f"{at}/all")
            return {_text(None): f"{write}/all"}
        # a copy of the column names the folder, so that files hold all columns
        named = rows.withColumn("_p", F.md5(F.coalesce(F.to_json(F.struct("project_id")), F.lit(""))))
        spread = named.repartition("_p", F.pmod(F.xxhash64(*rows.columns), F.lit(16)))
        spread.write.partitionBy("_p").parquet(at)
        back = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_p", T.StringType())])).parquet(at)
        return {_text(r["project_id"]): f"{write}/_p={r['_p']}" for r in back.select("project_id", "_p").distinct().collect()}

    def _next(self, name: str, old: Manifest, schema: T.StructType, **changes) -> None:
        folders = changes.get("folders", old.folders)
        new = {f for fs in folders.values() for f in fs}
        version = old.version + 1
        born = {f: old.born.get(f, version) for f in new}
        self._commit(name, replace(old, version=version, schema=json.dumps(schema.jsonValue()), born=born, **changes))

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """The table is these rows from now on."""
        old = self.manifest(name)
        self._next(name, old, rows.schema, folders={p: [f] for p, f in self._written(name, rows).items()}, tombstones=[])
        return self.read(name)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        old = self.manifest(name)
        folders = {p: list(fs) for p, fs in old.folders.items()}
        schema = self._same(old, rows)
        for p, f in self._written(name, self._shaped(rows, schema)).items():
            folders[p] = [*folders.get(p, []), f]
        self._next(name, old, schema, folders=folders)
        return self.read(name)

    def _same(self, old: Manifest, rows: DataFrame) -> T.StructType:
        """The table's columns, and those that the rows bring."""
        if not old.schema:
            return rows.schema
        known = T.StructType.fromJson(json.loads(old.schema))
        return T.StructType([*known.fields, *[f for f in rows.schema.fields if f.name not in known.names]])

    def _shaped(self, rows: DataFrame, schema: T.StructType) -> DataFrame:
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of the same keys are replaced; null equals null. Only projects that hold such rows, or that get some, are written again."""
        old = self.manifest(name)
        if not old.version:
            return self.write(name, rows)
        schema = self._same(old, rows)
        rows, given = self._shaped(rows, schema), rows.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        held = self._shaped(self._rows(name, old, sorted(old.folders)), schema)
        touched = {_text(None)}
        if "project_id" in schema.names:
            hit = held.join(given, same, "left_semi").select("project_id").unionByName(rows.select("project_id")).distinct()
            touched = {_text(r["project_id"]) for r in hit.collect()}
        before = self._shaped(self._rows(name, old, sorted(touched & set(old.folders))), schema)
        made = self._written(name, before.join(given, same, "left_anti").unionByName(rows))
        folders = {p: fs for p, fs in old.folders.items() if p not in touched} | {p: [f] for p, f in made.items()}
        self._next(name, old, schema, folders=folders)
        return self.read(name)

    def delete(self, names: list[str], **equal) -> None:
        """Rows that match in each of the tables that have these columns: a tombstone each, or, where only the project is asked for, its folders off the list."""
        for name in names:
            old = self.manifest(name)
            if not old.version:
                continue
            schema = T.StructType.fromJson(json.loads(old.schema))
            if set(equal) == {"project_id"} and "project_id" in schema.names:
                self._next(name, old, schema, folders={p: fs for p, fs in old.folders.items() if p != _text(equal["project_id"])})
            elif set(equal) <= set(schema.names):
                self._next(name, old, schema, tombstones=[*old.tombstones, {"version": old.version + 1, "equal": equal}])

    def remove(self, name: str, given: DataFrame, on: dict[str, str]) -> None:
        """Rows whose columns equal those of a given row (on: column here -> column there). Only projects that hold such rows are
        written again."""
        old = self.manifest(name)
        if not old.version:
            return
        schema = T.StructType.fromJson(json.loads(old.schema))
        keys = given.select(*[F.col(there).alias(f"_{here}") for here, there in on.items()]).distinct()
        same = F.lit(True)
        for here in on:
            same = same & (F.col(here) == F.col(f"_{here}"))
        held = self._rows(name, old, sorted(old.folders))
        hit = held.join(keys, same, "left_semi")
        touched = {_text(r["project_id"]) for r in hit.select("project_id").distinct().collect()} if "project_id" in schema.names else {_text(None)} if hit.limit(1).count() else set()
        if touched:
            made = self._written(name, self._rows(name, old, sorted(touched)).join(keys, same, "left_anti"))
            self._next(name, old, schema, folders={p: fs for p, fs in old.folders.items() if p not in touched} | {p: [f] for p, f in made.items()})

    def compact(self, name: str) -> DataFrame:
        """Projects with several folders, or older than a tombstone, as one folder each; tombstones are done with then."""
        old = self.manifest(name)
        schema = T.StructType.fromJson(json.loads(old.schema))
        last = max((t["version"] for t in old.tombstones), default=0)
        many = sorted(p for p, fs in old.folders.items() if len(fs) > 1 or any(old.born[f] < last for f in fs))
        made = self._written(name, self._rows(name, old, many)) if many else {}
        folders = {p: fs for p, fs in old.folders.items() if p not in many} | {p: [f] for p, f in made.items()}
        self._next(name, old, schema, folders=folders, tombstones=[])
        return self.read(name)

    def prune(self, name: str, keep: int = 2) -> None:
        """Delete all but the newest manifests, and the folders that none of those lists; a reader of an older version fails."""
        known = self.versions(name)
        for version in known[: -max(1, keep)]:
            self.fs.delete(self.path(f"{self.root}/{name}/manifests/{version:012d}.json"), False)
        self.vacuum(name)

    def vacuum(self, name: str) -> int:
        """Delete data folders that no manifest lists; how many. A writer that hasn't committed yet would lose its files: run it alone."""
        listed = {f for v in self.versions(name) for f in self.manifest(name, v).listed()}
        top, gone = self.path(f"{self.root}/{name}/data"), 0
        for write in self.fs.listStatus(top) if self.fs.exists(top) else []:
            inner = [s for s in self.fs.listStatus(write.getPath()) if s.isDirectory()]
            free = [s for s in inner if f"{write.getPath().getName()}/{s.getPath().getName()}" not in listed]
            for s in [write] if len(free) == len(inner) else free:
                self.fs.delete(s.getPath(), True)
            gone += len(free)
        return gone
