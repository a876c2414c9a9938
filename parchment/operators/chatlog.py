"""The log of questions and answers: what is added to it, what is read from it, how it is cleared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.operators import findings

COLUMNS = ["project_id", "id", "role", "title", "content", "unknown_scope", "citations_json", "evidence_id", "created_at"]


# The titles of answers.
GROUNDED, UNKNOWN = "带依据的回答", "I don't know"


def entries(answers: DataFrame, log: DataFrame) -> DataFrame:
    """Rows to add to a log for answers (project_id, pos, question, grounded, answer, citations, scope, evidence_id): each question, then
    the answer, whose words are kept only if it is grounded; both kinds name the first source. An answer with an error, if there
    is such a column, adds nothing, its question included. Ids run on from the project's last one."""
    last = log.groupBy("project_id").agg(F.max("id").alias("_last"))
    null = F.lit(None).cast("string")
    asked = F.struct(F.lit("user").alias("role"), null.alias("title"), F.col("question").alias("content"), null.alias("unknown_scope"), null.alias("citations_json"), null.alias("evidence_id"))
    sure = F.coalesce("grounded", F.lit(False))
    told = F.struct(
        F.lit("assistant").alias("role"),
        F.when(sure, GROUNDED).otherwise(UNKNOWN).alias("title"),
        F.when(sure, F.coalesce("answer", F.lit(""))).alias("content"),
        F.when(~sure, F.col("scope")).alias("unknown_scope"),
        F.to_json("citations").alias("citations_json"),
        F.col("evidence_id"),
    )
    rows = answers.where("error IS NULL") if "error" in answers.columns else answers
    rows = rows.select("project_id", F.col("pos").alias("_pos"), F.posexplode(F.array(asked, told)).alias("_turn", "_row"))
    rows = findings.numbered(rows.withColumn("_pos", F.col("_pos") * 2 + F.col("_turn")), "project_id", "_pos", to="_nth")
    return rows.join(last, "project_id", "left").select("project_id", (F.coalesce("_last", F.lit(0)) + F.col("_nth")).alias("id"), "_row.*", F.date_trunc("millisecond", F.current_timestamp()).alias("created_at"))


def history(log: DataFrame) -> DataFrame:
    """A log's rows as they are shown, to be read in order of project_id and id: citations as a list, none for what is no list."""
    cited = F.coalesce(F.from_json("citations_json", "array<string>"), F.array().cast("array<string>"))
    return log.select("project_id", "id", "role", "title", "content", "unknown_scope", cited.alias("citations"), "evidence_id")


def clear(log: DataFrame, projects: DataFrame) -> DataFrame:
    return log.join(projects.select("project_id").distinct(), "project_id", "left_anti")
