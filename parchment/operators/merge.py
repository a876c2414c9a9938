"""Keyed merges of what was discovered with what is stored, and the writes that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.functions.naming import BASE_VARIABLES
from parchment.functions.text import is_blank


def upsert(stored: DataFrame, found: DataFrame, keys: list[str], locked: Column, values: list[str]) -> DataFrame:
    """All keys of either side. Locked stored rows stay as they are; others take the found values; new keys come in.

    Adds outcome: kept (locked or not found), updated, inserted.
    """
    new = found.select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values], F.lit(True).alias("_found"))
    old = stored.withColumn("_stored", F.lit(True)).withColumn("_locked", F.coalesce(locked, F.lit(False)))
    both = old.join(new, keys, "full_outer")
    take = F.col("_found").isNotNull() & ~F.coalesce(F.col("_locked"), F.lit(False))
    outcome = F.when(F.col("_stored").isNull(), "inserted").when(take, "updated").otherwise("kept")
    merged = [F.when(take, F.col(f"_new_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    rest = [c for c in stored.columns if c not in keys and c not in values]
    return both.select(*keys, *merged, *rest, outcome.alias("outcome"))


def orphans(stored: DataFrame, found: DataFrame, keys: list[str], removable: Column) -> DataFrame:
    """Stored rows that may go and were not found."""
    return stored.where(removable).join(found.select(*keys).distinct(), keys, "left_anti")


def follow_default(stored: DataFrame, catalog: DataFrame, key: str, text: str, default: str) -> DataFrame:
    """Settings follow a new default unless they were changed; settings not stored yet come in with it."""
    new = catalog.select(key, F.col(default).alias("_default"))
    both = stored.join(new, key, "full_outer")
    customised = F.col(default).isNotNull() & ~F.col(text).eqNullSafe(F.col(default))
    current = F.when(customised | F.col("_default").isNull(), F.col(text)).otherwise(F.col("_default"))
    return both.select(key, current.alias(text), F.coalesce("_default", default).alias(default), F.coalesce(customised, F.lit(False)).alias("customised"))


def ensure_base(stored: DataFrame, projects: DataFrame) -> DataFrame:
    """Every project has each base variable; what the blueprint fixes follows it, values and confirmations stay."""
    spec = F.array(*[F.struct(F.lit(k).alias("var_key"), F.lit(i).alias("_order"), F.lit(label).alias("_label"), F.lit(action).alias("_action"), F.lit(files).alias("_affects"), F.lit(kind).cast("string").alias("_kind")) for i, (k, label, action, _, kind, files) in enumerate(BASE_VARIABLES)])
    wanted = projects.select("project_id").distinct().select("project_id", F.inline(spec))
    both = stored.join(wanted, ["project_id", "var_key"], "full_outer")
    fixed = F.col("_order").isNotNull()
    take = lambda new, old: F.when(fixed, F.col(new)).otherwise(F.col(old)).alias(old)
    rest = [c for c in stored.columns if c not in ("project_id", "var_key", "sort_order", "label", "action", "affects", "scope", "confirmed", "kind")]
    rest += [take("_kind", "kind")] * ("kind" in stored.columns)
    return both.select("project_id", "var_key", take("_order", "sort_order"), take("_label", "label"), take("_action", "action"), take("_affects", "affects"), F.when(fixed, "BASE").otherwise(F.col("scope")).alias("scope"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"), *rest)


def absent(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that are not stored yet: what a seed adds."""
    return rows.join(stored.select(*keys).distinct(), keys, "left_anti")


def patch(rows: DataFrame, where: Column, **values: Column | None) -> DataFrame:
    """Rows that match take the given values; a value of None changes nothing."""
    for name, value in values.items():
        if value is not None:
            rows = rows.withColumn(name, F.when(where, value).otherwise(F.col(name)))
    return rows


def confirm_all(variables: DataFrame, scope: str | None, file_key: str | None = None) -> DataFrame:
    """Confirms the variables of a file, of all files, or the base ones; confirmed_from is their file."""
    which = F.col("scope") == "BASE"
    if (scope or "").upper() == "FILE":
        which = F.col("file_key") == file_key if file_key else F.col("scope") == "FILE"
    return patch(variables, F.coalesce(which, F.lit(False)), confirmed=F.lit(True), confirmed_from=F.coalesce("file_key", F.lit("")))


def progress(variables: DataFrame, documents: DataFrame, generated: DataFrame) -> DataFrame:
    """For each project how far drafting is; each table is counted by itself and the counts are joined.

    The generated files' keys of a project meet in one value, so memory is bounded by a project's generated files.
    """
    base, own, sure = F.col("scope") == "BASE", F.col("scope") == "FILE", F.col("confirmed")
    v = variables.groupBy("project_id").agg(F.count_if(base).alias("base_total"), F.count_if(base & sure).alias("base_confirmed"), F.count_if(own).alias("file_total"), F.count_if(own & sure).alias("file_confirmed"))
    d = documents.groupBy("project_id").agg(F.count_if((F.col("category") == "STANDARD_TEMPLATE") & (F.col("parse_status") == "PARSED")).alias("template_count"), F.count_if(F.col("category") == "PROJECT_INPUT").alias("evidence_count"))
    g = generated.where("generated").groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "file_key"))), lambda x: x["file_key"]), ",").alias("generated_files"))
    out = v.join(d, "project_id", "full_outer").join(g, "project_id", "full_outer").na.fill(0).na.fill("", ["generated_files"])
    ready = (F.col("base_total") > 0) & (F.col("base_confirmed") == F.col("base_total"))
    return out.withColumn("base_ready", ready).withColumn("all_ready", ready & (F.col("file_confirmed") == F.col("file_total")))


def next_sort_order(variables: DataFrame) -> DataFrame:
    """For each project the place behind its last variable; one without a place counts as at 0."""
    return variables.groupBy("project_id").agg((F.greatest(F.max(F.coalesce("sort_order", F.lit(0))), F.lit(0)) + 1).alias("next_order"))


def parse_summary(docs: DataFrame) -> DataFrame:
    """For each project: files taken in, parsed, failed, and the messages of the first five failures in order.

    Failures are ranked and limited before they are gathered, so a project of any size holds five messages.
    """
    said = docs.where("parse_status = 'FAILED'").select(F.col("project_id").alias("_project"), "id", F.concat("file_name", F.lit(" failed")).alias("m"))
    first = said.withColumn("_nth", F.row_number().over(W.partitionBy("_project").orderBy("id", "m"))).where("_nth <= 5")
    messages = first.groupBy("_project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "m"))), lambda x: x["m"]), "; ").alias("_messages"))
    counts = docs.groupBy("project_id").agg(F.count("*").alias("accepted"), F.count_if(F.col("parse_status") == "PARSED").alias("parsed"), F.count_if(F.col("parse_status") == "FAILED").alias("failed"))
    both = counts.join(messages, F.col("project_id").eqNullSafe(F.col("_project")), "left")
    return both.select("project_id", "accepted", "parsed", "failed", F.coalesce("_messages", F.lit("")).alias("first_messages"))


def reset(rows: DataFrame, defaults: DataFrame, keys: list[str], where: Column) -> DataFrame:
    """Rows that match take the values of their default; a row without one stays."""
    values = [c for c in defaults.columns if c not in keys]
    new = defaults.select(*keys, F.struct(*values).alias("_default"))
    both = rows.join(new, keys, "left")
    take = F.coalesce(where, F.lit(False)) & F.col("_default").isNotNull()
    return both.select(*[F.when(take, F.col("_default")[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def replaced(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys come again are replaced, others are added: how vectors are kept by their ids."""
    return without(rows, new, keys).unionByName(new, allowMissingColumns=True)


def stamped(rows: DataFrame) -> DataFrame:
    """With updated_at, now to the millisecond, and created_at, kept where there is one."""
    now = F.date_trunc("millisecond", F.current_timestamp())
    created = F.coalesce("created_at", now) if "created_at" in rows.columns else now
    return rows.withColumn("created_at", created).withColumn("updated_at", now)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among those deleted."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def needs_text(docs: DataFrame) -> DataFrame:
    """Documents whose text is blank though a file is stored: they are parsed again."""
    return docs.where(is_blank(F.col("text_content")) & F.col("storage_path").isNotNull())
