"""Character budgets: shares of documents in order, cut texts, merged spans around markers, lines with keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.functions.naming import BASE_KEYWORDS, DECISION_MARKERS
from parchment.functions.text import CUT, is_blank, nvl, trim, truncate
from parchment.operators import scan

# Fixed values.
HEADER = "\n\n===== 文件：{} · {} =====\n"
EVIDENCE_HEADER = "\n\n=== {} ===\n"
NO_SNIPPETS, LEFT_OUT = "（无聚焦摘录）", "\n……（中间内容省略）……\n"
REVIEW, REVIEW_LEAST, REVIEW_MOST = 14_000, 1_200, 5_000


def review_shares(docs: DataFrame, budget: int = REVIEW, least: int = REVIEW_LEAST, most: int = REVIEW_MOST) -> DataFrame:
    """How much of each document (project_id, id, place, file_key, file_name, text_content) goes into a review, in order of
    places and ids; nth is its number there.

    Each document may use its part of what is left, between `least` and `most`; header and cut mark count as well; once
    nothing is left the rest is out. Only ids and lengths are folded, one array for each project; a fold by its nature
    goes in order, and stops needing rows once the budget is used, so at most budget / least documents are gathered.
    """
    lengths = docs.where(~is_blank(F.col("text_content"))).select(
        "project_id",
        "id",
        F.length("text_content").alias("n"),
        (F.length(nvl(F.col("file_key"))) + F.length(nvl(F.col("file_name"))) + len(HEADER.format("", ""))).alias("head"),
    )
    total = docs.groupBy("project_id").agg(F.count("*").alias("total"))
    place = docs.select("project_id", "id", F.row_number().over(W.partitionBy("project_id").orderBy("place", "id")).alias("nth"))
    # a document takes one character and a header at least, so no more than `budget` of them can matter
    first = place.where(F.col("nth") <= budget)
    items = lengths.join(first, ["project_id", "id"])
    listed = items.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "n", "head"))).alias("_docs")).join(total, "project_id")
    seed = F.struct(F.lit(budget).alias("left"), F.array().cast("array<struct<nth:int,id:bigint,used:int,cut:boolean>>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        share = F.floor(acc["left"] / F.greatest(F.lit(1), F.col("total") - (d["nth"] - 1))).cast("int")
        allow = F.least(F.lit(most), F.greatest(F.lit(least), share))
        used = F.least(d["n"], allow)
        cut = d["n"] > allow
        spent = used + d["head"] + F.when(cut, F.lit(len(CUT))).otherwise(0)
        entry = F.struct(d["nth"].cast("int").alias("nth"), d["id"].cast("bigint").alias("id"), used.cast("int").alias("used"), cut.alias("cut"))
        return F.when(acc["left"] <= 0, acc).otherwise(F.struct((acc["left"] - spent).cast("int").alias("left"), F.array_append(acc["out"], entry).alias("out")))

    return listed.select("project_id", F.inline(F.aggregate("_docs", seed, step)["out"]))


def evidence_shares(docs: DataFrame, budget: int = 8_000, least: int = 400) -> DataFrame:
    """How much of each document goes into a prompt as evidence: its part of what is left, `least` at the least, never more
    than is left behind its header; the first document that has no room ends it. Only lengths are folded, as above."""
    held = docs.where(~is_blank(F.col("text_content")))
    place = held.select("project_id", "id", F.row_number().over(W.partitionBy("project_id").orderBy("id")).alias("nth"), F.length("text_content").alias("n"), (F.length(nvl(F.col("file_name"))) + len(EVIDENCE_HEADER.format(""))).alias("head"))
    total = held.groupBy("project_id").agg(F.count("*").alias("total"))
    listed = place.where(F.col("nth") <= budget).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "n", "head"))).alias("_docs")).join(total, "project_id")
    seed = F.struct(F.lit(budget).alias("left"), F.array().cast("array<struct<id:bigint,used:int,cut:boolean>>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        share = F.greatest(F.lit(least), F.floor(acc["left"] / F.greatest(F.lit(1), F.col("total") - (d["nth"] - 1))).cast("int"))
        allow = F.least(share, acc["left"] - d["head"])
        used, cut = F.least(d["n"], allow), d["n"] > allow
        entry = F.struct(d["id"].cast("bigint").alias("id"), used.cast("int").alias("used"), cut.alias("cut"))
        spent = used + d["head"] + F.when(cut, F.lit(len(CUT))).otherwise(0)
        return F.when(allow <= 0, F.struct(F.lit(0).alias("left"), acc["out"].alias("out"))).otherwise(F.struct((acc["left"] - spent).cast("int").alias("left"), F.array_append(acc["out"], entry).alias("out")))

    return listed.select("project_id", F.inline(F.aggregate("_docs", seed, step)["out"]))


def merged_spans(rows: DataFrame, key: list[str], start: str = "start", end: str = "end", tie: str = "pos") -> DataFrame:
    """Overlapping or touching spans of a key as one: first start, last end, how many. Both scans run in slices of the order, so a
    key may hold all rows."""
    reached = scan.running(scan.sliced(rows, start), key, [start, tie], {"_reach": ("max", end)}, before=True)
    new = (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("int")
    island = scan.running(reached.withColumn("_new", new), key, [start, tie], {"_island": ("sum", "_new")})
    return island.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def _spans(text: Column, markers: list[str], before: int, after: int, most: int) -> Column:
    """Merged spans (start, end, n) around the markers of a text, the first `most` in order of markers and places: what marker_spans() gives,
    as an array in the text's row."""

    def places(marker: str) -> Column:
        # no more than `most` of a marker can count, so what stands behind them is left in one piece
        pieces, seed = F.split(text, f"\\Q{marker}\\E", most + 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, p: F.struct((a["at"] + F.length(p) + len(marker)).alias("at"), F.array_append(a["out"], a["at"] + F.length(p)).alias("out"))
        return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), seed, step)["out"]  # the last piece has no marker behind it

    found = F.array_sort(F.slice(F.concat(*map(places, markers)), 1, most))
    # all spans reach equally far, so in order of places both ends rise, and a gap is one between neighbours
    apart = lambda a, i, j: F.get(a, i) - before > F.get(a, j) + after
    clipped = lambda a: F.zip_with(
        F.filter(F.transform(a, lambda x, i: F.when((i == 0) | apart(a, i, i - 1), F.struct(i.alias("i"), x.alias("x")))), lambda s: s.isNotNull()),
        F.filter(F.transform(a, lambda x, i: F.when((i == F.size(a) - 1) | apart(a, i + 1, i), F.struct(i.alias("i"), x.alias("x")))), lambda s: s.isNotNull()),
        lambda s, e: F.struct(F.greatest(F.lit(0), s["x"] - before).alias("start"), F.least(F.length(text), e["x"] + after).alias("end"), (e["i"] - s["i"] + 1).cast("long").alias("n")),
    )
    # an array of one: the places are computed once, however often they are looked at
    return F.get(F.transform(F.array(found), clipped), F.lit(0))


def marker_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", markers: list[str] | None = None, before: int = 300, after: int = 500, most: int = 400) -> DataFrame:
    """Merged spans around the markers of each text, the first `most` in order of markers and places. Nothing leaves its row."""
    return docs.select(key, F.inline(_spans(F.col(text), markers or DECISION_MARKERS, before, after, most)))


def focused(docs: DataFrame, budget: int, text: str = "text", key: str = "doc_id", markers: list[str] | None = None) -> DataFrame:
    """Each text cut to what stands around its markers, or to its beginning if it has none."""
    gap = "\n……（未命中决策线索的正文省略）……\n"

    def said(spans: Column) -> Column:
        pieces = F.array_join(F.transform(spans, lambda s: F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])), gap)
        return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, F.substring(pieces, 1, budget)).otherwise(truncate(F.col(text), budget, CUT))

    spans = F.array(_spans(F.col(text), markers or DECISION_MARKERS, 300, 500, 400))
    return docs.withColumn("focused", trim(F.get(F.transform(spans, said), F.lit(0))))


def keyword_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", keywords: list[str] | None = None, least: int = 6) -> DataFrame:
    """Lines of at least six characters that hold a keyword, with their places from 0."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "line"))
    low = F.lower("line")
    hit = F.lit(False)
    for k in keywords or BASE_KEYWORDS:
        hit = hit | F.contains(low, F.lit(k))
    return lines.where(hit & (F.length(trim(F.col("line"))) >= least)).withColumn("line", trim(F.col("line")))


def snippets(docs: DataFrame, budget: int = 4_500, keywords: list[str] | None = None) -> DataFrame:
    """For each project (project_id, snippets) the lines of its input files that hold a keyword, each file's name once before
    them, until the budget is used; the line that goes over it is cut.

    An entry takes nine characters at least, so no more than budget / 9 lines of a project are gathered.
    """
    inputs = docs.where("category = 'PROJECT_INPUT'")
    lines = keyword_lines(inputs.withColumn("_of", F.struct("project_id", "id", "file_name")), "text_content", "_of", keywords)
    ranked = lines.select("_of.*", "pos", "line").withColumn("_k", F.row_number().over(W.partitionBy("project_id").orderBy("id", "pos"))).where(F.col("_k") <= budget // 9)
    listed = ranked.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("_k", "id", "file_name", "line"))).alias("_lines"))

    def add(so_far: Column, x: Column) -> Column:
        head = F.when(x["id"].eqNullSafe(so_far["id"]), "").otherwise(F.concat(F.lit("\n["), nvl(x["file_name"]), F.lit("]\n")))
        entry, left = F.concat(F.lit("  "), x["line"], F.lit("\n")), so_far["left"] - F.length(head)
        said = F.concat(so_far["said"], head, F.substring(entry, F.lit(1), F.greatest(left, F.lit(0))))
        more = F.struct(F.greatest(left - F.length(entry), F.lit(0)).alias("left"), x["id"].alias("id"), said.alias("said"))
        return F.when(so_far["left"] <= 0, so_far).otherwise(more)

    seed = F.struct(F.lit(budget).alias("left"), F.lit(None).cast(docs.schema["id"].dataType).alias("id"), F.lit("").alias("said"))
    found = listed.select("project_id", trim(F.aggregate("_lines", seed, add)["said"]).alias("_said"))
    return docs.select("project_id").distinct().join(found, "project_id", "left").select("project_id", F.coalesce(F.nullif("_said", F.lit("")), F.lit(NO_SNIPPETS)).alias("snippets"))


def templates(docs: DataFrame, budget: int = 14_000, least: int = 1_500, whole: int = 8_000, opening: int = 1_800, markers: list[str] | None = None) -> DataFrame:
    """For each project (project_id, templates) its standard templates, each by its part of what is left of the budget, `least`
    at the least: a text of up to `whole` characters from its beginning, a longer one around its markers, behind its opening
    where more than 800 characters are left for it. Only lengths are folded; at most budget characters of texts are gathered.
    """
    own = docs.where("category = 'STANDARD_TEMPLATE'")
    total = own.groupBy("project_id").agg(F.count("*").alias("total"))
    place = own.select("project_id", "id", F.row_number().over(W.partitionBy("project_id").orderBy("id")).alias("nth")).where(F.col("nth") <= budget)
    read = own.where(~is_blank(F.col("text_content"))).select("project_id", "id", F.col("text_content").alias("raw"), F.concat(F.lit("\n\n=== "), nvl(F.col("file_name")), F.lit(" ===\n")).alias("head"))
    read = focused(read.withColumn("_key", F.struct("project_id", "id")), 1 << 30, "raw", "_key", markers)
    long = F.length("raw") > whole
    marked = F.when(long & (F.col("focused") != trim(F.col("raw"))), F.col("focused"))  # null: no marker
    read = read.select("project_id", "id", "raw", "head", marked.alias("marked"), long.alias("long"))
    sizes = read.join(place, ["project_id", "id"]).select("project_id", F.struct("nth", "id", F.length("raw").alias("n"), F.length("head").alias("h"), F.length("marked").alias("m"), "long").alias("d"))
    listed = sizes.groupBy("project_id").agg(F.array_sort(F.collect_list("d")).alias("_docs")).join(total, "project_id")

    def step(acc: Column, d: Column) -> Column:
        share = F.greatest(F.lit(least), F.floor(acc["left"] / F.greatest(F.lit(1), F.col("total") - (d["nth"] - 1))).cast("int"))
        allow = F.least(share, acc["left"] - d["h"])
        body = F.when(d["m"].isNotNull(), F.least(d["m"], allow)).otherwise(F.least(d["n"], allow) + F.when(d["n"] > allow, F.lit(len(CUT))).otherwise(0))
        first = F.when(d["long"] & (allow - body > 800), F.least(F.lit(opening), allow - body)).otherwise(0)
        spent = d["h"] + body + F.when(first > 0, first + len(CUT) + len(LEFT_OUT)).otherwise(0)
        entry = F.struct(d["nth"].cast("int").alias("nth"), d["id"].cast("bigint").alias("id"), allow.cast("int").alias("allow"), first.cast("int").alias("first"))
        done = F.struct(F.lit(0).alias("left"), acc["out"].alias("out"))
        return F.when((acc["left"] <= 0) | (allow <= 0), done).otherwise(F.struct((acc["left"] - spent).cast("int").alias("left"), F.array_append(acc["out"], entry).alias("out")))

    seed = F.struct(F.lit(budget).alias("left"), F.array().cast("array<struct<nth:int,id:bigint,allow:int,first:int>>").alias("out"))
    shares = listed.select("project_id", F.inline(F.aggregate("_docs", seed, step)["out"]))
    parts = read.join(shares, ["project_id", "id"])
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, F.lit(1), n), F.lit(CUT))).otherwise(F.col(c))
    body = F.when(F.col("marked").isNull(), cut("raw", F.col("allow"))).otherwise(F.substring("marked", F.lit(1), F.col("allow")))
    before = F.when(F.col("first") > 0, F.concat(cut("raw", F.col("first")), F.lit(LEFT_OUT))).otherwise("")
    return parts.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.concat("head", before, body).alias("s")))).alias("_s")).select("project_id", trim(F.array_join(F.transform("_s", lambda x: x["s"]), "")).alias("templates"))


def evidence(docs: DataFrame) -> DataFrame:
    """For each project (project_id, evidence) its input files, cut to evidence_shares()."""
    own = docs.where("category = 'PROJECT_INPUT'")
    parts = own.join(evidence_shares(own), ["project_id", "id"])
    body = F.concat(F.lit("\n\n=== "), nvl(F.col("file_name")), F.lit(" ===\n"), F.expr("substring(text_content, 1, used)"), F.when(F.col("cut"), F.lit(CUT)).otherwise(""))
    listed = parts.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("id", body.alias("s")))).alias("_s"))
    return listed.select("project_id", trim(F.array_join(F.transform("_s", lambda x: x["s"]), "")).alias("evidence"))
