"""Reports: markdown as classed lines, documents from variables, downloads with a byte-order mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.naming import affects_file, file_title
from parchment.functions.text import nvl


def markdown_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Lines of a simple markdown text: kind (blank, rule, h1-h3, quote, item, text) and what they say without marks."""
    lines = docs.select(key, F.posexplode(F.split(F.replace(nvl(F.col(text)), F.lit("\r\n"), F.lit("\n")), "\n")).alias("pos", "_raw"))
    line = F.regexp_replace("_raw", r"\s+$", "")
    kind = (
        F.when(F.trim(line) == "", "blank")
        .when(line.rlike(r"^---+\s*$"), "rule")
        .when(F.startswith(line, F.lit("### ")), "h3")
        .when(F.startswith(line, F.lit("## ")), "h2")
        .when(F.startswith(line, F.lit("# ")), "h1")
        .when(F.startswith(line, F.lit("> ")), "quote")
        .when(line.rlike(r"^[-*] "), "item")
        .otherwise("text")
    )
    said = F.regexp_replace(F.regexp_replace(line, r"^(#{1,3} |> |[-*] )", ""), r"\*\*|`", "")
    return lines.select(key, "pos", kind.alias("kind"), said.alias("content"))


def fallback_document(variables: DataFrame, keys: list[str], contract_no: Column) -> DataFrame:
    """For each project and file, one that no variable affects too, the confirmed points as markdown, for when a model gives no text."""
    spark = variables.sparkSession
    files = spark.createDataFrame([(k,) for k in keys], "doc_key string")
    held = variables.join(F.broadcast(files), affects_file(F.col("file_key"), F.col("affects"), F.col("doc_key")))
    point = F.concat(F.lit("- **"), nvl(F.col("label")), F.lit("**（"), nvl(F.col("action")), F.lit("）："), nvl(F.col("value_text")), F.lit("\n"))
    points = held.groupBy("project_id", "doc_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "var_key", point.alias("p")))), lambda x: x["p"]), "").alias("_points"))
    every = variables.groupBy("project_id").agg(F.min(contract_no).alias("_no")).select("*", F.explode(F.array(*map(F.lit, keys))).alias("doc_key"))
    head = F.concat(F.lit("## "), file_title(F.col("doc_key")), F.lit("\n\n**Contract No.** "), nvl(F.col("_no")), F.lit("\n\n"))
    points = every.join(points, ["project_id", "doc_key"], "left")
    return points.select("project_id", "doc_key", F.concat(head, nvl(F.col("_points")), F.lit("\n> 模型未返回正文，以上为按已确认变量生成的条款要点。\n")).alias("content"))


def download(title: Column, content: Column) -> Column:
    """A markdown file's text: byte-order mark, title, content."""
    return F.concat(F.lit("﻿# "), nvl(title), F.lit("\n\n"), nvl(content))


def excerpts(hits: Column) -> Column:
    """hits (file_label, page_no, anchor, content) as numbered paragraphs."""
    return F.array_join(F.transform(hits, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), nvl(h["file_label"]), F.lit("  "), nvl(h["page_no"]), F.lit("  "), nvl(h["anchor"]), F.lit("\n"), nvl(h["content"]))), "\n\n")
