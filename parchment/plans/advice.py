"""Questions on a project's documents: the index of chunks, what is retrieved, the grounded answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.functions import naming
from parchment.functions.text import is_blank, nvl, trim
from parchment.operators import chatlog, chunk, providers, report, search

ANSWER = "grounded boolean, answer string, citations array<string>, missingReason string"
NOTHING = "Searched selected scope · no basis"


def rebuild_index(docs: DataFrame, provider: providers.Embed = providers.stub_embed) -> DataFrame:
    """All chunks of documents with text, numbered, with their vectors."""
    text = docs.where(~is_blank(F.col("text_content")))
    return chunk.index(text, chunk.split(F.col("text_content"))).withColumn("embedding", providers.embed(F.col("content"), provider))


def ask(questions: DataFrame, chunks: DataFrame, chat: providers.Chat, provider: providers.Embed = providers.stub_embed) -> DataFrame:
    """questions (project_id, question; scope, pos if they are there): one for each project, answered by what its chunks say.

    Gives pos, question, scope, grounded, title, answer, unknown_scope, citations, evidence_id, sources (file_label, page_no, anchor,
    content, score) and error: 4202 for a blank question, 4204 where the project has no chunk, 4203 where the model failed. A
    question without hits is not sent to the model. An answer counts if the model says that it is grounded; labels of the first
    sources stand in for missing citations, and lead the citations of an answer that doesn't count.
    """
    null = F.lit(None).cast("string")
    q = questions.select("project_id", (F.col("pos") if "pos" in questions.columns else F.lit(0)).cast("long").alias("pos"), trim(nvl(F.col("question"))).alias("question"), (F.col("scope") if "scope" in questions.columns else null).alias("scope"))
    q = q.withColumn("scope", F.when(is_blank(F.col("scope")), "fullset").otherwise(F.col("scope")))
    indexed = chunks.select("project_id", F.lit(True).alias("_indexed")).distinct()
    q = q.join(indexed, "project_id", "left").withColumn("error", F.when(F.col("question") == "", 4202).when(F.col("_indexed").isNull(), 4204)).drop("_indexed")
    asked = q.where("error IS NULL")
    queries = asked.select("project_id", providers.embed(F.col("question"), provider).alias("query"))
    hits = search.retrieve(chunks, queries)
    one = F.struct("rank", *[nvl(F.col(c)).alias(c) for c in ("file_label", "page_no", "anchor", "content")], F.col("score").cast("double").alias("score"))
    # the longest context is the stuffing limit or the chunks of a search, whatever the project's size
    context = hits.groupBy("project_id").agg(F.array_sort(F.collect_list(one)).alias("_hits"))
    held = asked.drop("error").join(context, "project_id", "left")
    prompt = F.concat(F.lit("Scope: "), naming.scope_label(F.col("scope")), F.lit("\n\n"), report.excerpts(F.col("_hits")), F.lit("\n\nQuestion: "), F.col("question"))
    said = providers.complete_json(held.where("_hits IS NOT NULL").withColumn("prompt", prompt), chat).drop("prompt", "raw")
    said = said.withColumn("error", F.when(F.col("error").isNotNull(), 4203)).withColumn("_a", F.from_json("answer", ANSWER)).drop("answer")
    rest = q.where("error IS NOT NULL").unionByName(held.where("_hits IS NULL"), allowMissingColumns=True)
    every = said.unionByName(rest, allowMissingColumns=True)
    labels = F.slice(F.array_distinct(F.transform("_hits", lambda h: h["file_label"])), 1, 3)
    right = F.col("error").isNull()
    grounded = right & F.coalesce(F.col("_a.grounded"), F.lit(False)) & ~is_blank(F.col("_a.answer"))
    cited = F.when(F.size("_a.citations") > 0, F.col("_a.citations")).otherwise(labels)
    unknown = F.when(F.col("_hits").isNotNull(), F.array_compact(F.array_append(labels, F.col("_a.missingReason")))).otherwise(F.array(F.lit(NOTHING)))
    return every.select(
        "project_id",
        "pos",
        "question",
        "scope",
        F.when(right, grounded).alias("grounded"),
        F.when(right, F.when(grounded, chatlog.GROUNDED).otherwise(chatlog.UNKNOWN)).alias("title"),
        F.when(grounded, F.col("_a.answer")).alias("answer"),
        F.when(right & ~grounded, F.col("scope")).alias("unknown_scope"),
        F.when(right, F.when(grounded, cited).otherwise(unknown)).alias("citations"),
        F.when(right, F.concat(F.lit("chunk:"), F.get("_hits", F.lit(0))["file_label"])).alias("evidence_id"),
        F.when(right, F.coalesce(F.transform("_hits", lambda h: h.dropFields("rank")), F.array().cast("array<struct<file_label:string,page_no:string,anchor:string,content:string,score:double>>"))).alias("sources"),
        "error",
    )


__all__ = ["ask", "rebuild_index"]
