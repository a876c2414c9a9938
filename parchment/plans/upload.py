"""Files that people send for a project: kept paths, parsed texts, and the documents that they make or replace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.functions import naming
from parchment.functions.text import stored_path
from parchment.operators import findings
from parchment.sources.files import Parser, parse

TEMPLATE, INPUT, PACKAGE = "STANDARD_TEMPLATE", "PROJECT_INPUT", "VETTING_PACKAGE"
#: What a file says of a document beside its text.
SAID = ["file_name", "size_bytes", "storage_path", "parse_status", "parse_message"]


def received(files: DataFrame, category: str, root: str, plugins: dict[str, Parser] | None = None, file_key: str | None = None) -> DataFrame:
    """files (project_id, pos, file_name, content) as project_id, pos, category, file_key, SAID, text_content. Empty files are passed
    over. A template's key is in its name (the first one if none is) or given, a package's is in its name, inputs have none."""
    if file_key is not None and file_key not in naming.TEMPLATE_KEYS:
        raise ValueError(f"4009: no template {file_key!r}")
    path = stored_path(root, F.col("project_id").cast("string"), F.lit(category), F.col("file_name"), F.col("content"))
    sent = files.where(F.octet_length("content") > 0).select("project_id", "pos", F.col("file_name").alias("_name"), F.octet_length("content").cast("long").alias("size_bytes"), path.alias("path"), "content")
    said = parse(sent, plugins, keep=("project_id", "pos", "_name", "size_bytes")).drop("file_name").withColumnsRenamed({"_name": "file_name", "path": "storage_path"})
    keys = {TEMPLATE: naming.match_template_key(F.col("file_name")), PACKAGE: naming.match_file_key(F.col("file_name"))}
    key = F.lit(file_key) if file_key is not None else keys.get(category, F.lit(None))
    return said.select("project_id", "pos", F.lit(category).alias("category"), key.cast("string").alias("file_key"), *SAID, "text_content")


def added(docs: DataFrame, said: DataFrame) -> DataFrame:
    """docs and a new document for each file; ids run on from the project's last one, in the order of pos."""
    last = docs.groupBy("project_id").agg(F.max("id").alias("_last"))
    nth = findings.numbered(said.select("project_id", "pos"), "project_id", "pos", to="_nth")
    new = said.join(nth, ["project_id", "pos"]).join(last, "project_id", "left").withColumn("id", (F.coalesce("_last", F.lit(0)) + F.col("_nth")).cast("long"))
    return docs.unionByName(new.drop("pos", "_nth", "_last"), allowMissingColumns=True)


def templates(docs: DataFrame, said: DataFrame, fresh: bool = False) -> DataFrame:
    """docs after templates came: a project's first document of a key takes what the last file of that key says, and the text of
    the last one that could be parsed (its own if none could; fresh: none then). Where a project has no document of the
    key, one is made; where the first one is no template, one for each file."""
    first = findings.first_wins(docs.where("file_key IS NOT NULL").select("project_id", "file_key", "id", "category"), ["project_id", "file_key"], "id")
    both = said.join(first.select("project_id", "file_key", F.col("id").alias("_id"), (F.col("category") == TEMPLATE).alias("_own")), ["project_id", "file_key"], "left")
    other = both.where(~F.coalesce("_own", F.col("_id").isNull()))
    parsed = F.when(F.col("parse_status") == "PARSED", F.col("pos"))
    one = both.where(F.coalesce("_own", F.col("_id").isNull())).groupBy("project_id", "file_key", "_id").agg(F.max_by(F.struct("pos", "category", *SAID), "pos").alias("_row"), F.max_by("text_content", parsed).alias("text_content"))
    one = one.select("project_id", "file_key", "_id", "_row.*", "text_content")
    new = one.where("_id IS NULL").drop("_id").unionByName(other.drop("_id", "_own"))
    over = one.where("_id IS NOT NULL").select("project_id", F.col("_id").alias("id"), F.struct(*SAID, "text_content").alias("_new"))
    held = docs
    for c in SAID:
        if c not in docs.columns:
            held = held.withColumn(c, F.lit(None).cast(said.schema[c].dataType))
    joined = held.join(over, ["project_id", "id"], "left")
    took = F.col("_new").isNotNull()
    values = {c: F.when(took, F.col("_new")[c]).otherwise(F.col(c)) for c in SAID}
    values["text_content"] = F.when(took & (F.lit(fresh) | F.col("_new.text_content").isNotNull()), F.col("_new.text_content")).otherwise(F.col("text_content"))
    return added(joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in held.columns]), new)


def result(files: DataFrame, said: DataFrame) -> DataFrame:
    """For each project: files sent (empty ones too), parsed, failed."""
    done = said.groupBy("project_id").agg(F.count_if(F.col("parse_status") == "PARSED").alias("parsed"), F.count_if(F.col("parse_status") == "FAILED").alias("failed"))
    return files.groupBy("project_id").agg(F.count("*").alias("accepted")).join(done, "project_id", "left").na.fill(0, ["parsed", "failed"])
