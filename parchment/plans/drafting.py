"""Variables of a draft: what a model found against what is stored, and the documents that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import naming
from parchment.functions.text import CUT, is_blank, nvl, sanitize_key, trim, truncate
from parchment.operators import budget, findings, merge, providers, report

CONFIDENCE = 0.70
VALUES = ["value_text", "choice", "source_ref", "label", "action", "affects", "kind", "file_key", "sort_order", "scope"]


def named(records: DataFrame) -> DataFrame:
    """records (project_id, pos, key) with var_key: the key's allowed characters, or a running number of those without any."""
    key = sanitize_key(F.col("key"))
    keyed = records.withColumn("var_key", key)
    blank = findings.numbered(keyed.where(is_blank(key)), "project_id", "pos", to="_nth")
    return keyed.where(~is_blank(key)).unionByName(blank.withColumn("var_key", F.format_string("VAR-%02d", "_nth")).drop("_nth"))


def cleaned(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A model's records (project_id, pos, key, scope, file_key, label, action, options, affects, value, source, confidence)
    with settled keys. Unsure file variables are gone, and those that call themselves base ones but have no base key; a later record of a key
    wins. Base variables take all but their value from the blueprint. File variables stand from place 1000 on, each record of
    one counting, but for those whose key is confirmed in `stored` (project_id, var_key, confirmed): they have no place."""
    spec = records.sparkSession.createDataFrame([(k, i, label, action, options, kind, affects) for i, (k, label, action, options, kind, affects) in enumerate(naming.BASE_VARIABLES)], "base_key string, base_pos int, base_label string, base_action string, base_options array<string>, base_kind string, base_affects string")
    r = named(records).join(F.broadcast(spec), F.lower("var_key") == F.lower("base_key"), "left")
    known = F.col("base_key").isNotNull()
    invented = (F.lower(nvl(F.col("scope"))) == "base") & ~known
    r = r.where(((F.coalesce("confidence", F.lit(0.8)) >= CONFIDENCE) | known) & ~invented)
    sure = F.lit(False)
    if stored is not None:
        confirmed = stored.where("confirmed").select("project_id", "var_key", F.lit(True).alias("_sure")).distinct()
        r = r.join(confirmed, ["project_id", "var_key"], "left")
        sure = F.coalesce("_sure", F.lit(False))
    own_places = findings.numbered(r.where(~known & ~sure).select("project_id", "pos"), "project_id", "pos", to="_nth")
    own = [c for c in r.columns if c not in ("project_id", "var_key")]
    last = r.groupBy("project_id", "var_key").agg(F.max_by(F.struct(*own), "pos").alias("_r")).select("project_id", "var_key", "_r.*")
    last = last.join(own_places, ["project_id", "pos"], "left")
    value, said = nvl(F.col("value")), F.lower(trim(nvl(F.col("action"))))
    action = F.coalesce("base_action", F.when(said.isin(naming.ACTIONS), said), F.lit("fill"))
    listed = F.when(F.col("base_kind") == "list", naming.normalize_list(value)).otherwise(value)
    fitted = naming.choice_of(naming.normalize_choice(listed, F.col("base_options")), F.col("base_options"))
    return last.select(
        "project_id",
        "var_key",
        listed.alias("value_text"),
        F.when(action == "choice", F.when(known, fitted).otherwise(value)).alias("choice"),
        truncate(F.col("source"), 480, CUT).alias("source_ref"),
        F.coalesce("base_label", truncate(F.col("label"), 480, CUT)).alias("label"),
        action.alias("action"),
        F.coalesce("base_affects", naming.sanitize_affects(F.col("affects"))).alias("affects"),
        F.col("base_kind").alias("kind"),
        F.when(~known, naming.file_key(trim(F.col("file_key")), naming.TEMPLATE_KEYS)).alias("file_key"),
        F.when(known, F.col("base_pos")).otherwise((999 + F.col("_nth")).cast("int")).alias("sort_order"),
        F.when(known, "BASE").otherwise("FILE").alias("scope"),
    )


def reconcile(records: DataFrame, stored: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """stored (project_id, var_key, confirmed, VALUES) after a run: every project (of `projects`, or that is stored or spoken of) has
    the base variables; confirmed rows stay, found ones take new values, file variables that were not found again go. A file
    variable that is no choice keeps the choice that it had."""
    of = projects if projects is not None else stored.select("project_id").unionByName(records.select("project_id"))
    held = merge.ensure_base(stored, of)
    blueprint = F.lower("var_key").isin([k.lower() for k, *_ in naming.BASE_VARIABLES])
    held = held.withColumn("file_key", F.when(~blueprint, F.col("file_key")))
    found = cleaned(records, held)
    had = held.select("project_id", "var_key", F.col("choice").alias("_had"))
    found = found.join(had, ["project_id", "var_key"], "left").withColumn("choice", F.when((F.col("scope") == "FILE") & (F.col("action") != "choice"), F.col("_had")).otherwise(F.col("choice"))).drop("_had")
    merged = merge.upsert(held, found, ["project_id", "var_key"], F.col("confirmed"), VALUES)
    gone = merge.orphans(held, found, ["project_id", "var_key"], ~F.coalesce(F.col("confirmed"), F.lit(False)) & (F.col("scope") != "BASE"))
    return merge.without(merged, gone, ["project_id", "var_key"]).withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


ANSWER = "title string, content string"
NO_TEMPLATE = "（未上传该文件的标准模板，请按已确认变量直接起草）"
MOST = 8_000


def extraction_prompts(docs: DataFrame, instruction: str = "Variables of this draft, as a JSON list.") -> DataFrame:
    """For each project (project_id, prompt) what a model is asked to find variables in: templates, evidence, telling lines."""
    parts = docs.select("project_id").distinct().join(budget.templates(docs), "project_id", "left").join(budget.evidence(docs), "project_id", "left").join(budget.snippets(docs), "project_id", "left")
    return parts.select("project_id", F.concat_ws("\n\n", F.lit(instruction), *[F.coalesce(c, F.lit("")) for c in ("templates", "evidence", "snippets")]).alias("prompt"))


def draft_prompts(variables: DataFrame, docs: DataFrame, contract_no: Column, keys: list[str] = naming.TEMPLATE_KEYS) -> DataFrame:
    """For each project and file (project_id, doc_key, prompt) what a model is asked to write: title and contract number, the
    variables that affect the file as a JSON list in their order, and the file's template. A project's variables of one file
    meet in one value, as they do in the prompt."""
    wanted = variables.select("project_id").distinct().select("project_id", F.explode(F.array(*map(F.lit, keys))).alias("doc_key"))
    affects = naming.affects_file(F.col("file_key"), F.col("affects"), F.col("doc_key"))
    item = F.struct(F.col("var_key").alias("key"), nvl(F.col("label")).alias("label"), nvl(F.col("action")).alias("action"), nvl(F.col("value_text")).alias("value"))
    said = variables.join(wanted, "project_id").where(affects).groupBy("project_id", "doc_key").agg(F.array_sort(F.collect_list(F.struct("sort_order", "var_key", item.alias("v")))).alias("_v"))
    first = findings.first_wins(docs.where("file_key IS NOT NULL").select("project_id", "file_key", "id", "category", "text_content"), ["project_id", "file_key"], "id")
    own = first.where("category = 'STANDARD_TEMPLATE'").select("project_id", F.col("file_key").alias("doc_key"), truncate(F.col("text_content"), MOST, CUT).alias("_template"))
    numbers = variables.select("project_id", contract_no.alias("_no")).groupBy("project_id").agg(F.min("_no").alias("_no"))
    held = wanted.join(said, ["project_id", "doc_key"], "left").join(own, ["project_id", "doc_key"], "left").join(numbers, "project_id", "left")
    listed = F.coalesce(F.to_json(F.transform("_v", lambda x: x["v"])), F.lit("[]"))
    return held.select("project_id", "doc_key", F.concat_ws("\n\n", F.concat(naming.file_title(F.col("doc_key")), F.lit(" / "), nvl(F.col("_no"))), listed, F.coalesce("_template", F.lit(NO_TEMPLATE))).alias("prompt"))


def draft(variables: DataFrame, docs: DataFrame, contract_no: Column, chat: providers.Chat, keys: list[str] = naming.TEMPLATE_KEYS) -> DataFrame:
    """project_id, doc_key, title, content of projects whose variables are all confirmed: what the model wrote, or the points of
    the confirmed variables where it gave no content."""
    sure = _settled(variables)
    said = providers.complete_json(draft_prompts(sure, docs, contract_no, keys), chat)
    said = said.select("project_id", "doc_key", F.from_json("answer", ANSWER)["content"].alias("_content"))
    plain = report.fallback_document(sure, keys, contract_no).withColumnRenamed("content", "_plain")
    both = said.join(plain, ["project_id", "doc_key"], "left")
    return both.select("project_id", "doc_key", naming.file_title(F.col("doc_key")).alias("title"), F.coalesce("_content", "_plain").alias("content"))


def create(stored: DataFrame, bodies: DataFrame) -> DataFrame:
    """Variables that people add (project_id, pos, key, file_key, label, action, value, options, affects, source): each row with
    var_key and error, null where it is taken; then its columns are a stored row's. 4007: no key or no file, 4008: a key that
    is there already, or that an earlier row takes. Places run on from the project's last one."""
    b = bodies.withColumn("var_key", sanitize_key(nvl(F.col("key")))).withColumn("file_key", naming.file_key(trim(F.col("file_key")), naming.TEMPLATE_KEYS))
    known = stored.select("project_id", "var_key", F.lit(True).alias("_known")).distinct()
    b = b.join(known, ["project_id", "var_key"], "left")
    error = F.when(F.col("var_key") == "", 4007).when(F.col("_known"), 4008).when(F.col("file_key").isNull(), 4007)
    b = b.withColumn("error", error)
    first = b.where("error IS NULL").groupBy("project_id", "var_key").agg(F.min("pos").alias("_first"))
    b = b.join(first, ["project_id", "var_key"], "left").withColumn("error", F.when(F.col("error").isNull() & (F.col("pos") > F.col("_first")), 4008).otherwise(F.col("error")))
    nth = findings.numbered(b.where("error IS NULL").select("project_id", "pos"), "project_id", "pos", to="_nth")
    b = b.join(nth, ["project_id", "pos"], "left").join(merge.next_sort_order(stored), "project_id", "left")
    action = F.lower(trim(nvl(F.col("action"))))
    return b.select(
        "project_id", "pos", "var_key", "error", F.lit("FILE").alias("scope"), "file_key",
        truncate(F.col("label"), 480, CUT).alias("label"),
        F.when(action.isin(naming.ACTIONS), action).otherwise("fill").alias("action"),
        nvl(F.col("value")).alias("value_text"),
        F.when(action == "choice", F.filter(F.transform("options", trim), lambda o: o != "")).alias("options"),
        truncate(F.col("affects"), 128, CUT).alias("affects"),
        truncate(F.col("source"), 512, CUT).alias("source_ref"),
        F.lit(False).alias("confirmed"),
        (F.coalesce("next_order", F.lit(1)) + F.col("_nth") - 1).cast("int").alias("sort_order"),
    )


def _settled(variables: DataFrame) -> DataFrame:
    """Variables of projects that have none to confirm; one that was never looked at is open."""
    open_ = variables.groupBy("project_id").agg(F.count_if(~F.coalesce(F.col("confirmed"), F.lit(False))).alias("_open")).where("_open = 0").select("project_id")
    return variables.join(open_, "project_id")


def generate(variables: DataFrame, contract_no: Column, keys: list[str] = naming.TEMPLATE_KEYS) -> DataFrame:
    """Documents of projects whose variables are all confirmed, without a model."""
    return report.fallback_document(_settled(variables), keys, contract_no)
