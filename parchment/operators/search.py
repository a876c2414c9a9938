"""Nearest vectors, the switch between using every chunk and searching, keyword and facet filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.functions.text import is_blank, nvl, trim
from parchment.functions.vectors import cosine

TOP_K, TOP_K_FLOOR, THRESHOLD, STUFFING_LIMIT = 6, 20, 0.35, 30_000


def nearest(vectors: DataFrame, query: Column, k: int, threshold: float, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The k rows of highest cosine to one query vector, at least the threshold; ties by id."""
    scored = vectors.withColumn("score", cosine(F.col(vector), query)).where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), tie).limit(k)


def nearest_per_group(vectors: DataFrame, queries: DataFrame, group: str, k: int, threshold: float, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """Each group's k nearest to the group's query (one row of group, query); ranks are limited before the shuffle."""
    scored = vectors.join(queries, group).withColumn("score", cosine(F.col(vector), F.col("query"))).where(F.col("score") >= threshold)
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), tie)))
    return ranked.where(F.col("rank") <= k).drop("query")


def stuffing(chunks: DataFrame, project: str, content: str, limit: int = STUFFING_LIMIT) -> DataFrame:
    """For each project the chunks, their characters, and whether they are few enough to use all."""
    return chunks.groupBy(project).agg(F.count("*").alias("n_chunks"), F.sum(F.length(nvl(F.col(content)))).alias("total_chars")).withColumn("stuffed", F.col("total_chars") <= limit)


def counts(vectors: DataFrame, group: str) -> DataFrame:
    """How many vectors a group has."""
    return vectors.groupBy(group).agg(F.count("*").alias("n"))


def first_labels(hits: DataFrame, group: str, label: str, order: list[str], most: int = 3) -> DataFrame:
    """The first different labels of each group, in the order in which they come; ranked and limited before they are gathered."""
    first = hits.groupBy(group, label).agg(F.min(F.struct(*order)).alias("_at"))
    ranked = first.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy("_at", label))).where(F.col("_k") <= most)
    return ranked.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(label).alias("l")))), lambda x: x["l"]).alias("labels"))


def grouped(rows: DataFrame, group: str, order: list[str], item: list[str]) -> DataFrame:
    """Each group with its items in order, and the place of the group: that of its first item. Memory is bounded by a group's
    items, prompts of a catalogue."""
    key = F.struct(*order)
    listed = F.array_sort(F.collect_list(F.struct(key.alias("o"), F.struct(*item).alias("i"))))
    return rows.groupBy(group).agg(F.min(key).alias("first"), F.count("*").alias("n"), F.transform(listed, lambda x: x["i"]).alias("items"))


def retrieve(chunks: DataFrame, queries: DataFrame, project: str = "project_id", content: str = "content", order: str = "chunk_index", vector: str = "embedding", limit: int = STUFFING_LIMIT, top_k: int = TOP_K, floor: int = TOP_K_FLOOR, threshold: float = THRESHOLD) -> DataFrame:
    """project's chunks: all of them in order, score 1, where they are few; else those nearest to the project's query."""
    how = stuffing(chunks, project, content, limit).select(project, "stuffed")
    held = chunks.join(how, project)
    every = held.where("stuffed").withColumn("score", F.lit(1.0)).withColumn("rank", F.row_number().over(W.partitionBy(project).orderBy(order)))
    near = nearest_per_group(held.where("NOT stuffed"), queries, project, max(top_k, floor), threshold, vector, order)
    return every.unionByName(near.select(*every.columns))


def keyword(word: str, columns: list[str]) -> Column:
    """The trimmed word, in any case, in one of the columns; a blank word holds for all rows."""
    low = trim(F.lit(word.lower()))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(nvl(F.col(c))), low)
    return is_blank(F.lit(word)) | hit


def facets(**wanted: str | None) -> Column:
    """All columns equal what is asked; blank or 'all' asks nothing."""
    out = F.lit(True)
    for column, value in wanted.items():
        if value and value.strip() and value != "all":
            out = out & F.coalesce(F.col(column) == value, F.lit(False))
    return out
