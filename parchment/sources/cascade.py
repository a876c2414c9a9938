"""Deletion by declared keys: what refers to a deleted row goes before it, in all tables, then its files.

Keys are declared once; a deletion walks them from the rows that are asked for to all that refer to them, rows of rows too, and removes
children before parents, so that a run that dies can be run again: what is left still hangs on its parent. Paths of files are noted in a table
of the store before their rows go, and struck off when the files are gone, so they are not forgotten either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.sources import blobs
from parchment.sources.scratch import stored
from parchment.sources.store import Store


@dataclass(frozen=True)
class Key:
    """Rows of `child` refer by `column` to the row of `parent` that has the value in `target`."""

    child: str
    column: str
    parent: str
    target: str = "id"


#: The tables of a project.
KEYS = [
    *[Key(t, "project_id", "project") for t in ("vetting_finding", "evidence_chunk", "evidence_vector", "chat_message", "draft_document", "draft_variable", "source_document")],
    Key("evidence_chunk", "document_id", "source_document"),
    Key("evidence_vector", "document_id", "source_document"),
]
#: Columns that name files.
FILES = {"source_document": "storage_path"}
PENDING = "file_to_delete"


class Cascade:
    def __init__(self, store: Store, keys: list[Key] = KEYS, files: dict[str, str] = FILES):
        self.store, self.keys, self.files = store, keys, files

    def _below(self, table: str) -> list[str]:
        """Tables that refer to this one, through others too, children before parents; this one is the last."""
        out: list[str] = []

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in path:
                raise ValueError(f"keys go round in a circle: {' -> '.join((*path, name))}")
            for k in self.keys:
                if k.parent == name:
                    visit(k.child, (*path, name))
            if name not in out:
                out.append(name)

        visit(table, ())
        return out

    def delete(self, table: str, given: DataFrame, on: dict[str, str] | None = None) -> dict[str, int]:
        """Rows of a table that equal a given row (on: column here -> column there; by default id), and all that refers to them. How many rows each
        table lost, and how many files went."""
        spark, order = self.store.spark, self._below(table)
        on = on or {"id": "id"}
        gone: dict[str, DataFrame] = {}
        for name in reversed(order):  # parents first: whose rows will go
            if not self.store.exists(name):
                continue
            rows = self.store.read(name)
            parts = []
            if name == table:
                match = F.lit(True)
                for here, there in on.items():
                    match = match & (rows[here] == given[there])
                parts.append(rows.join(given, match, "left_semi"))
            for k in self.keys:
                if k.child == name and k.parent in gone:
                    parents = gone[k.parent].select(F.col(k.target).alias("_of")).distinct()
                    parts.append(rows.join(parents, F.col(k.column) == F.col("_of"), "left_semi"))
            if parts:
                found = parts[0]
                for other in parts[1:]:
                    found = found.unionByName(other)
                gone[name] = stored(found.distinct(), f"gone-{name}")
        counts = {name: df.count() for name, df in gone.items()}
        for name, column in self.files.items():
            if counts.get(name):
                self.store.append(PENDING, gone[name].select(F.col(column).cast("string").alias("storage_path")).where("storage_path IS NOT NULL"))
        for name in order:  # children first
            if counts.get(name):
                columns = {c: c for c in ({"id"} & set(gone[name].columns) or set(gone[name].columns))}
                self.store.remove(name, gone[name], columns)
        return counts | {"files": self.finish(spark)}

    def finish(self, spark) -> int:
        """Delete the files that are noted, of an earlier run too; those that can't be deleted stay noted."""
        if not self.store.exists(PENDING):
            return 0
        noted = stored(self.store.read(PENDING).distinct(), "noted")
        if noted.limit(1).count() == 0:
            return 0
        # a path that a row still names stays
        for name, column in self.files.items():
            if self.store.exists(name):
                used = self.store.read(name).select(F.col(column).alias("storage_path"))
                noted = noted.join(used, "storage_path", "left_anti")
        done = stored(blobs.delete(noted), "deleted")
        self.store.write(PENDING, done.where("error IS NOT NULL").select("storage_path"))
        self.store.prune(PENDING)
        return done.where("deleted").count()

    def orphans(self) -> dict[str, int]:
        """For each declared key how many rows refer to nothing."""
        out = {}
        for k in self.keys:
            if self.store.exists(k.child) and self.store.exists(k.parent):
                parents = self.store.read(k.parent).select(F.col(k.target).alias("_of")).distinct()
                rows = self.store.read(k.child).where(F.col(k.column).isNotNull())
                out[f"{k.child}.{k.column}"] = rows.join(parents, F.col(k.column) == F.col("_of"), "left_anti").count()
        return out
