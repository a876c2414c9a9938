"""A query for each operator on the driver's tables, with its SQL beside it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.functions import jsontext, naming, text
from parchment.operators import budget, chatlog, chunk, findings, locate, many, merge, providers, report, search, sourceset
from parchment.plans import advice, drafting, upload, vetting
from parchment.sources import files
from parchment.queries.derived import ACCEPTED, RECORDS, SOURCE_DOCUMENTS, VARIABLES, one_of, records, source_documents, sql_one_of, table, variables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_COSINE = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


# ---- vectors


@query(f"SELECT vec_id, label, round(score, 6) AS score FROM (SELECT a.vec_id, a.label, {_COSINE} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b) WHERE score >= -1 ORDER BY score DESC, vec_id LIMIT 20")
def knn_topk(spark, d):
    e = table(spark, d, "embeddings")
    asked = F.array(*[F.lit(x).cast("float") for x in e.where("vec_id = 0").first()["embedding"]])
    return search.nearest(e, asked, 20, -1.0).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"""WITH q AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
s AS (SELECT a.label, a.vec_id, {_COSINE} AS score FROM embeddings a JOIN q b ON a.label = b.label)
SELECT label, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.05) WHERE rank <= 20""")
def knn_per_label(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query"))
    return search.nearest_per_group(e, queries, "label", 20, 0.05).select("label", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nth FROM embeddings) WHERE nth <= 3),
s AS (SELECT a.label, b.vec_id AS query_id, a.vec_id, round({_COSINE}, 9) AS score FROM q b JOIN embeddings a ON a.label = b.label AND (b.nth <> 2 OR a.vec_id // 10 BETWEEN b.vec_id // 10 AND b.vec_id // 10 + 20))
SELECT label, query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= -0.5) WHERE rank <= 10""")
def knn_many(spark, d):
    """Three questions for each label, the second of them among some documents only."""
    e = table(spark, d, "embeddings").withColumn("document_id", F.floor(F.col("vec_id") / 10).cast("long"))
    first = e.withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy("vec_id"))).where("nth <= 3")
    few = F.when(F.col("nth") == 2, F.sequence(F.col("document_id"), F.col("document_id") + 20))
    queries = first.select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), few.alias("documents"))
    return many.nearest(e, queries, 10, -0.5, project="label").withColumn("score", F.round("score", 6))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def vector_counts(spark, d):
    return search.counts(table(spark, d, "embeddings"), "label")


@query("""WITH p AS (SELECT vec_id, list_filter(CAST(embedding AS DOUBLE[]), lambda x, i: i % 2 = 1) AS xs, list_filter(CAST(embedding AS DOUBLE[]), lambda x, i: i % 2 = 0) AS ys FROM embeddings)
SELECT vec_id, round(list_min(xs), 5) AS x, round(list_min(ys), 5) AS y, round(list_max(xs) - list_min(xs), 5) AS w, round(list_max(ys) - list_min(ys), 5) AS h FROM p""")
def bbox_minmax(spark, d):
    """Boxes around polygons in a recogniser's answer; a vector's components are a polygon's points."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda i: F.struct(F.get(wide, 2 * i).alias("x"), F.get(wide, 2 * i + 1).alias("y")))
    answer = F.to_json(F.struct(F.lit("line").alias("text"), points.alias("points")))
    boxes = table(spark, d, "embeddings").select("vec_id", F.get(jsontext.parse_ocr(answer), F.lit(0))["bbox"].alias("b"))
    return boxes.select("vec_id", *[F.round(F.col("b")[c], 5).alias(c) for c in "xywh"])


# ---- text

_TRIM = r"regexp_replace({0}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_NORMAL = _TRIM.format(r"regexp_replace(regexp_replace(replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


@query("SELECT doc_id, md5(" + _NORMAL.format("coalesce(text, '') || chr(13) || chr(10) || chr(10) || chr(10) || chr(160) || ' x' || chr(9)") + ") AS normal FROM documents")
def normalize_text(spark, d):
    messy = F.concat(text.nvl(F.col("text")), F.lit("\r\n\n\n  x\t"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize(messy).cast("binary")).alias("normal"))


_STRIP = "coalesce(html, '')"
for _p, _by in ((r"(?is)<script[^>]*>.*?</script>", "' '"), (r"(?is)<style[^>]*>.*?</style>", "' '"), (r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)</(p|div|tr|li|h[1-6])>", "chr(10)"), (r"<[^>]+>", "' '"), ("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), (r"[ \t]+", "' '")):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', {_by}, 'g')"


@query(f"SELECT page_id, md5({_NORMAL.format(_STRIP)}) AS said FROM pages")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.normalize(text.strip_html(F.col("html"))).cast("binary")).alias("said"))


@query(r"SELECT doc_id, regexp_extract(text || ' see ' || ['SCC 4.1(a)', 'gcc 9', 'NTT3(b)(ii)', 'XSL 2'][doc_id % 4 + 1], '\b((?:NTT|SCT|SCC|GCT|GCC|FT|AA|SL|PRE)\s?\d+(?:\.\d+)*(?:\([a-z0-9]+\))*)', 1) AS anchor FROM documents")
def anchor_extract(spark, d):
    said = F.concat("text", F.lit(" see "), one_of(["SCC 4.1(a)", "gcc 9", "NTT3(b)(ii)", "XSL 2"], F.col("doc_id") % 4))
    return table(spark, d, "documents").select("doc_id", text.nvl(text.anchor(said)).alias("anchor"))


@query("SELECT doc_id, CASE WHEN i > 200 THEN '...' ELSE '' END || " + _TRIM.format("substr(text, greatest(0, i - 200) + 1, least(n, i + 520) - greatest(0, i - 200))") + " || CASE WHEN i + 520 < n THEN '...' ELSE '' END AS excerpt FROM (SELECT doc_id, text, length(text) AS n, CAST(length(text) // 2 AS INTEGER) AS i FROM documents)")
def excerpt_window(spark, d):
    return table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("excerpt"))


@query("""SELECT doc_id, CASE WHEN length(text) > 480 THEN substr(text, 1, 480) ELSE text END AS hard, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || chr(10) || '...[已截断]' ELSE text END AS soft,
CASE WHEN length(c) > 200 THEN substr(c, 1, 200) || '...' ELSE c END AS one_line FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)""".replace("\\\\", "\\"))
def truncate_text(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.truncate(t, 480).alias("hard"), text.truncate(t, 400, text.CUT).alias("soft"), text.compact(t, 200).alias("one_line"))


@query(r"""SELECT conv_id, turn, substr(regexp_replace(trim(text), '[^A-Za-z0-9_\-]', '', 'g'), 1, 64) AS var_key, md5(regexp_replace(text, '[\\/:*?"<>|]', '_', 'g')) AS file_name FROM conversations""")
def sanitize_names(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.sanitize_key(F.col("text")).alias("var_key"), F.md5(text.safe_file_name(F.col("text")).cast("binary")).alias("file_name"))


@query("""SELECT o_orderkey, o_orderpriority, CASE WHEN v IN ('是', '否', '待确认') THEN v WHEN v IN ('yes', 'Y', '1') THEN '是' WHEN v IN ('No', 'false') THEN '否' WHEN v LIKE 'Pending%' OR v LIKE '%TBD%' THEN '待确认' WHEN v LIKE 'tender a%' THEN 'Tender A' ELSE v END AS choice
FROM (SELECT o_orderkey, o_orderpriority, ['yes', 'No', 'Y', 'Pending x', 'a TBD', 'tender a (x)', '是', '1', 'false', o_orderpriority][o_orderkey % 10 + 1] AS v FROM orders)""")
def choice_normalize(spark, d):
    v = F.coalesce(one_of(["yes", "No", "Y", "Pending x", "a TBD", "tender a (x)", "是", "1", "false"], F.col("o_orderkey") % 10), "o_orderpriority")
    options = F.array(*map(F.lit, ("是", "否", "待确认")))
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", naming.normalize_choice(v, options).alias("choice"))


@query(r"""SELECT doc_id, CASE WHEN v = '' THEN '[]' WHEN starts_with(v, '[') THEN text ELSE CAST(to_json(list_filter(list_transform(regexp_split_to_array(replace(replace(replace(v, '\r\n', chr(10)), '\n', chr(10)), '\r', chr(10)), '\r?\n'), lambda x: """ + _TRIM.format("x") + r"""), lambda x: x <> '')) AS VARCHAR) END AS items
FROM (SELECT doc_id, text, """ + _TRIM.format("coalesce(text, '')") + r""" AS v FROM documents)""")
def list_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", naming.normalize_list(F.col("text")).alias("items"))


@query("""SELECT doc_id, list_slice(list_distinct_first, 1, 8) AS needles FROM (SELECT doc_id, list_filter(all_, lambda x, i: list_position(all_, x) = i) AS list_distinct_first FROM (
SELECT doc_id, list_concat(CASE WHEN length(loc) >= 5 THEN [loc] ELSE [] END, list_filter(regexp_split_to_array(loc, '[·→↔|,;\\s]+'), lambda t: length(t) >= 5),
  CASE WHEN length(ref) >= 5 THEN [ref] ELSE [] END, list_filter(regexp_split_to_array(ref, '[·→↔|,;\\s]+'), lambda t: length(t) >= 5)) AS all_
FROM (SELECT doc_id, 'SCC ' || (doc_id % 300) || '.10' AS loc, 'NTT3(b) → SCT' || (doc_id % 600) || ', clause' AS ref FROM documents))) x""".replace("\\\\", "\\"))
def needles(spark, d):
    i = F.col("doc_id")
    loc = F.concat(F.lit("SCC "), (i % 300).cast("string"), F.lit(".10"))
    ref = F.concat(F.lit("NTT3(b) → SCT"), (i % 600).cast("string"), F.lit(", clause"))
    return table(spark, d, "documents").select("doc_id", text.needles_of(loc, ref).alias("needles"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS pos, line FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE length(trim(line)) >= 6 AND (" + " OR ".join(f"contains(lower(line), '{k}')" for k in naming.BASE_KEYWORDS) + ")")
def base_snippets(spark, d):
    return budget.keyword_lines(table(spark, d, "documents")).select("doc_id", "pos", "line")


@query("SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN trim(line) = '' THEN 'blank' WHEN starts_with(line, '## ') THEN 'h2' WHEN starts_with(line, '- ') THEN 'item' ELSE 'text' END AS kind FROM (SELECT doc_id, unnest(string_split('## T' || chr(10) || chr(10) || '- **a**' || chr(10) || text, chr(10))) AS line FROM documents)) GROUP BY ALL")
def markdown_kinds(spark, d):
    made = table(spark, d, "documents").select("doc_id", F.concat(F.lit("## T\n\n- **a**\n"), "text").alias("text"))
    return report.markdown_lines(made).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


# ---- names and codes


@query(f"WITH {SOURCE_DOCUMENTS} SELECT id, file_key, CASE WHEN regexp_matches(lower(file_name), '\\.(eml|msg)$') THEN '邮件' WHEN ends_with(lower(file_name), '.pdf') THEN 'PDF' WHEN regexp_matches(lower(file_name), '\\.docx?$') THEN 'Word' ELSE '文本' END AS type_label, CASE parse_status WHEN 'PARSED' THEN 'ok' WHEN 'FAILED' THEN 'danger' ELSE 'info' END AS tag FROM sd")
def document_labels(spark, d):
    return source_documents(spark, d).select("id", "file_key", naming.document_type(F.lit(None).cast("string"), F.col("file_name")).alias("type_label"), naming.status_tag(F.col("parse_status")).alias("tag"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_type ELSE p_name END AS zh_hant, p_brand AS en, p_name AS zh_hans FROM part")
def localized_pick(spark, d):
    s = F.col("p_size") % 3
    own = naming.localized(F.col("p_name"), F.when(s == 0, "").when(s == 1, F.col("p_type")), F.col("p_brand"))
    made = table(spark, d, "part").select("p_partkey", own.alias("t"))
    return made.select("p_partkey", naming.pick(F.col("t"), "zh-Hant").alias("zh_hant"), naming.pick(F.col("t"), "en").alias("en"), naming.pick(F.col("t"), "zh-Hans").alias("zh_hans"))


@query(f"WITH {ACCEPTED} SELECT pos, types, {'CASE WHEN trim(types) = ' + chr(39) * 2 + ' THEN ' + chr(39) + 'risk' + chr(39) + ' ELSE group_key END'} AS group_key FROM single")
def group_of(spark, d):
    typed = records(spark, d).where(~text.is_blank(F.col("types"))).withColumn("k", text.dedupe_key(*map(F.col, ("types", "refs", "location", "title", "quote"))))
    return findings.first_wins(typed, ["project_id", "k"], "pos").select("pos", "types", naming.group_of(F.col("types")).alias("group_key"))


@query("SELECT p_partkey, string_split(p_type, ' ') AS words, list_contains(list_transform(string_split(p_brand || ', ' || p_type || ' ,SCC', ','), lambda x: trim(x)), p_type) AS held FROM part")
def csv_arrays(spark, d):
    return table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("words"), naming.affects_file(F.lit(None).cast("string"), F.concat("p_brand", F.lit(", "), "p_type", F.lit(" ,SCC")), F.col("p_type")).alias("held"))


@query(f"WITH {VARIABLES} SELECT id, CASE WHEN len(l) = 0 THEN NULL ELSE array_to_string(l, ',') END AS affects FROM (SELECT id, list_filter(list_transform(string_split(coalesce(affects, ''), ','), lambda x: upper(trim(x))), lambda x: x IN ('NTT', 'SCT', 'SCC')) AS l FROM dv)")
def affects_clean(spark, d):
    return variables(spark, d).select("id", naming.sanitize_affects(F.col("affects")).alias("affects"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n, md5(text) AS said FROM documents")
def json_unwrap(spark, d):
    """Each text's lines as a model's list: wrapped under one name or another, fenced, with words before and behind."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line")))
    wrapped = F.concat(F.lit('{"'), one_of(jsontext.WRAPPERS, F.col("doc_id") % 6), F.lit('": '), F.to_json(lines), F.lit("}"))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), wrapped, F.lit("\n``` done"))).otherwise(F.concat(F.lit("Here it is: "), wrapped, F.lit(" (end)")))
    items = table(spark, d, "documents").select("doc_id", jsontext.json_items(said).alias("items"))
    back = F.array_join(F.transform("items", lambda x: F.from_json(x, "line string")["line"]), "\n")
    return items.select("doc_id", F.size("items").alias("n"), F.md5(back.cast("binary")).alias("said"))


@query("""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), k AS (SELECT * FROM l WHERE regexp_matches(line, '[^\\x00-\\x20]'))
SELECT d.doc_id, CAST(count(k.i) AS INTEGER) AS n_lines, round(avg((length(line) % 10) / 10.0), 6) AS mean_confidence, CAST(coalesce(sum(length(line)), 0) AS BIGINT) AS width, coalesce(md5(string_agg(line, chr(10) ORDER BY i)), md5('')) AS said
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY 1""".replace("\\\\", "\\"))
def ocr_answers(spark, d):
    """Each text's lines as a recogniser's answer."""
    n = lambda x: F.length(x).cast("double")
    line = lambda x: F.struct(x.alias("rec_text"), (F.length(x) % 10 / 10.0).alias("score"), F.array(F.array(n(x), F.lit(1.0)), F.array(F.lit(0.0), F.lit(3.0))).alias("poly"))
    answer = F.to_json(F.struct(F.array(F.struct(F.transform(F.split("text", "\n"), line).alias("lines"))).alias("results")))
    lines = table(spark, d, "documents").select("doc_id", jsontext.parse_ocr(answer).alias("l"))
    return lines.select("doc_id", F.size("l").alias("n_lines"), F.round(jsontext.mean_confidence(F.col("l")), 6).alias("mean_confidence"), F.aggregate("l", F.lit(0).cast("bigint"), lambda s, x: s + x["bbox"]["w"].cast("bigint")).alias("width"), F.md5(F.array_join(F.transform("l", lambda x: x["text"]), "\n").cast("binary")).alias("said"))


# ---- findings


@query(f"WITH {ACCEPTED} SELECT * FROM accepted")
def finding_codes(spark, d):
    return findings.accept(records(spark, d))


@query(f"WITH {ACCEPTED}, b AS (SELECT project_id, count(*) AS said, count(*) FILTER (trim(types) = '') AS blank FROM rec GROUP BY 1), c AS (SELECT project_id, count(*) AS n, count(*) FILTER (group_key = 'risk' AND r > 10) AS over_cap FROM capped GROUP BY 1) SELECT b.project_id, said, blank, said - blank - coalesce(n, 0) AS repeated, coalesce(over_cap, 0) AS over_cap FROM b LEFT JOIN c ON b.project_id = c.project_id")
def run_counts(spark, d):
    return findings.run_counts(records(spark, d))


@query(f"WITH {ACCEPTED} SELECT project_id, count(*) FILTER (group_key = 'reference') AS reference, count(*) FILTER (group_key = 'conflict') AS conflict, count(*) FILTER (group_key = 'language') AS language, count(*) FILTER (group_key = 'risk') AS risk, count(*) AS total, count(*) FILTER (scope = 'inter') AS cross_file FROM accepted GROUP BY 1")
def finding_metrics(spark, d):
    return findings.metrics(findings.accept(records(spark, d)))


@query(f"WITH {ACCEPTED} SELECT project_id, code, group_key, coalesce(lag(group_key) OVER (PARTITION BY project_id ORDER BY code) <> group_key, true) AS header FROM accepted")
def report_headers(spark, d):
    return findings.report_rows(findings.accept(records(spark, d))).select("project_id", "code", "group_key", "header")


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'tion') AND lang = 'en'")
def facet_keyword(spark, d):
    rows = table(spark, d, "documents").where(search.facets(lang="en", source="all") & search.keyword(" TION ", ["text"]))
    return rows.select("doc_id", "lang", "source")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND (contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderstatus), 'urgent'))")
def facet_orders(spark, d):
    return table(spark, d, "orders").where(search.facets(o_orderstatus="O", o_orderpriority="") & search.keyword("URGENT", ["o_orderpriority", "o_orderstatus"])).select("o_orderkey", "o_orderstatus", "o_orderpriority")


# ---- source sets and merges

_READABLE = SOURCE_DOCUMENTS + r", base AS (SELECT * FROM sd WHERE parse_status = 'PARSED' AND " + _TRIM.format("coalesce(text_content, '')") + " <> '')"


@query(f"WITH {_READABLE} SELECT project_id, file_key, id, length(text_content) AS n FROM (SELECT *, row_number() OVER (PARTITION BY project_id, file_key ORDER BY length(text_content) DESC, id) AS k FROM base) WHERE k = 1")
def longest_per_key(spark, d):
    return sourceset.longest_per_key(sourceset.readable(source_documents(spark, d))).select("project_id", "file_key", "id", F.length("text_content").cast("long").alias("n"))


_ORDER = "coalesce(list_position(['NTT', 'SCT', 'SCC', 'GCT', 'FT', 'AA', 'GCC', 'SL', 'PRE'], {0}), 10)"


_REVIEWABLE = f"""{_READABLE}, tier AS (SELECT project_id, min(CASE WHEN category = 'VETTING_PACKAGE' THEN 1 WHEN file_key IS NOT NULL THEN 2 WHEN category NOT IN ('VETTING_SUPPLEMENT', 'PROJECT_INPUT') THEN 3 ELSE 4 END) AS tier FROM base GROUP BY 1),
th AS (SELECT b.*, t.tier FROM base b JOIN tier t ON b.project_id = t.project_id WHERE (tier = 1 AND category = 'VETTING_PACKAGE') OR (tier = 2 AND file_key IS NOT NULL) OR (tier = 3 AND category NOT IN ('VETTING_SUPPLEMENT', 'PROJECT_INPUT')) OR tier = 4),
tr AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_key ORDER BY length(text_content) DESC, id) AS tk FROM th),
reviewable AS (SELECT *, CAST({_ORDER.format('file_key')} AS INTEGER) AS rank, CASE WHEN tier IN (2, 3) THEN {_ORDER.format('file_key')} ELSE 0 END AS place FROM tr WHERE tier IN (1, 4) OR tk = 1)"""


@query(f"WITH {_REVIEWABLE} SELECT project_id, id, file_key, tier, rank, CAST(place AS INTEGER) AS place FROM reviewable")
def source_set_tiers(spark, d):
    return sourceset.reviewable(source_documents(spark, d)).select("project_id", "id", "file_key", "tier", F.col("rank").cast("int").alias("rank"), F.col("place").cast("int").alias("place"))


@query(f"""WITH {SOURCE_DOCUMENTS}, o AS (SELECT *, coalesce(file_key, 'OTHER:' || id) AS list_key FROM sd WHERE category IN ('VETTING_SUPPLEMENT', 'VETTING_PACKAGE')),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, list_key ORDER BY id) AS k FROM o) WHERE k = 1),
n AS (SELECT *, file_key AS list_key FROM sd WHERE category = 'STANDARD_TEMPLATE' AND file_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM own WHERE own.project_id = sd.project_id AND own.list_key = sd.file_key)),
new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, list_key ORDER BY id) AS k FROM n) WHERE k = 1),
b AS (SELECT project_id, list_key, id, parse_status, page_count, 0 AS phase FROM own UNION ALL SELECT project_id, list_key, id, parse_status, page_count, 1 FROM new),
c AS (SELECT *, {_ORDER.format('list_key')} AS place, row_number() OVER (PARTITION BY project_id, {_ORDER.format('list_key')} = 10 ORDER BY phase, id) AS nth FROM b)
SELECT project_id, list_key, id, CAST(CASE WHEN place = 10 THEN 9 + nth ELSE place END AS INTEGER) AS rank, list_key IN ('NTT', 'SCT', 'SCC') AS generated, parse_status = 'PARSED' OR list_key IN ('NTT', 'SCT', 'SCC') AS parsed, page_count FROM c""")
def listed_files(spark, d):
    return sourceset.listed_files(source_documents(spark, d)).withColumn("rank", F.col("rank").cast("int"))


@query(f"WITH {SOURCE_DOCUMENTS}, k AS (SELECT DISTINCT project_id, unnest(['NTT', 'SCT', 'SCC']) AS file_key FROM sd), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, file_key ORDER BY id DESC) AS n FROM sd WHERE category = 'STANDARD_TEMPLATE') WHERE n = 1) SELECT k.project_id, k.file_key, l.id, coalesce(l.parse_status, 'MISSING') AS parse_status FROM k LEFT JOIN l ON k.project_id = l.project_id AND k.file_key = l.file_key")
def left_default(spark, d):
    docs = source_documents(spark, d)
    keys = docs.select("project_id").distinct().select("project_id", F.explode(F.array(*map(F.lit, naming.TEMPLATE_KEYS))).alias("file_key"))
    held = sourceset.with_defaults(keys, docs.where("category = 'STANDARD_TEMPLATE'"), ["project_id", "file_key"])
    return held.select("project_id", "file_key", "id", F.coalesce("parse_status", F.lit("MISSING")).alias("parse_status"))


@query(f"WITH {VARIABLES}, s AS (SELECT * FROM dv WHERE id % 4 <> 1), f AS (SELECT project_id, var_key, value_text || '!' AS value_text FROM dv WHERE id % 3 <> 1) SELECT coalesce(s.project_id, f.project_id) AS project_id, coalesce(s.var_key, f.var_key) AS var_key, CASE WHEN f.var_key IS NOT NULL AND NOT coalesce(s.confirmed, false) THEN f.value_text ELSE s.value_text END AS value_text, CASE WHEN s.var_key IS NULL THEN 'inserted' WHEN f.var_key IS NOT NULL AND NOT s.confirmed THEN 'updated' ELSE 'kept' END AS outcome FROM s FULL OUTER JOIN f ON s.project_id = f.project_id AND s.var_key = f.var_key")
def upsert_confirmed(spark, d):
    v = variables(spark, d)
    found = v.where("id % 3 <> 1").withColumn("value_text", F.concat("value_text", F.lit("!")))
    return merge.upsert(v.where("id % 4 <> 1"), found, ["project_id", "var_key"], F.col("confirmed"), ["value_text"]).select("project_id", "var_key", "value_text", "outcome")


@query(f"WITH {VARIABLES} SELECT id FROM dv WHERE NOT confirmed AND scope <> 'BASE' AND id % 3 = 1")
def delete_orphans(spark, d):
    v = variables(spark, d)
    return merge.orphans(v, v.where("id % 3 <> 1"), ["project_id", "var_key"], ~F.col("confirmed") & (F.col("scope") != "BASE")).select("id")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_partkey % 5 <> 0 THEN p_type ELSE p_brand END AS body, CASE WHEN p_partkey % 5 <> 0 THEN p_type ELSE p_brand END AS default_body, p_size % 2 = 0 AS customised FROM part WHERE p_name <> p_brand")
def follow_default(spark, d):
    p = table(spark, d, "part").where("p_name <> p_brand")
    stored = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("body"), F.col("p_brand").alias("default_body"))
    catalog = p.where("p_partkey % 5 <> 0").select("p_partkey", F.col("p_type").alias("default_body"))
    return merge.follow_default(stored, catalog, "p_partkey", "body", "default_body")


@query(f"WITH {VARIABLES} SELECT id, confirmed OR coalesce(file_key = 'SCT', false) AS confirmed FROM dv")
def confirm_all(spark, d):
    return merge.confirm_all(variables(spark, d).withColumn("confirmed_from", F.lit("")), "FILE", "SCT").select("id", "confirmed")


@query(f"WITH {VARIABLES} SELECT project_id, greatest(max(coalesce(sort_order, 0)), 0) + 1 AS next_order FROM dv GROUP BY 1")
def next_sort_order(spark, d):
    return merge.next_sort_order(variables(spark, d))


@query(f"""WITH {VARIABLES}, v AS (SELECT CAST(project_id AS VARCHAR) AS project_id, count(*) FILTER (scope = 'BASE') AS base_total, count(*) FILTER (scope = 'BASE' AND confirmed) AS base_confirmed, count(*) FILTER (scope = 'FILE') AS file_total, count(*) FILTER (scope = 'FILE' AND confirmed) AS file_confirmed FROM dv GROUP BY 1),
{SOURCE_DOCUMENTS}, t AS (SELECT substr(project_id, 4) AS project_id, count(*) FILTER (category = 'STANDARD_TEMPLATE' AND parse_status = 'PARSED') AS template_count, count(*) FILTER (category = 'PROJECT_INPUT') AS evidence_count, coalesce(string_agg(file_key, ',' ORDER BY id) FILTER (id % 50 = 0 AND file_key IS NOT NULL), '') AS generated_files FROM sd GROUP BY 1)
SELECT coalesce(v.project_id, t.project_id) AS project_id, coalesce(base_total, 0) AS base_total, coalesce(base_confirmed, 0) AS base_confirmed, coalesce(file_total, 0) AS file_total, coalesce(file_confirmed, 0) AS file_confirmed, coalesce(template_count, 0) AS template_count, coalesce(evidence_count, 0) AS evidence_count, coalesce(generated_files, '') AS generated_files,
coalesce(base_total > 0 AND base_total = base_confirmed, false) AS base_ready, coalesce(base_total > 0 AND base_total = base_confirmed AND file_total = file_confirmed, false) AS all_ready FROM v FULL OUTER JOIN t ON v.project_id = t.project_id""")
def progress(spark, d):
    v = variables(spark, d).withColumn("project_id", F.col("project_id").cast("string"))
    docs = source_documents(spark, d).withColumn("project_id", F.expr("substring(project_id, 4)"))
    made = docs.where("file_key IS NOT NULL").withColumn("generated", F.col("id") % 50 == 0)
    return merge.progress(v, docs, made)


@query(f"WITH {SOURCE_DOCUMENTS} SELECT project_id, count(*) AS accepted, count(*) FILTER (parse_status = 'PARSED') AS parsed, count(*) FILTER (parse_status = 'FAILED') AS failed, coalesce(string_agg(file_name || ' failed', '; ' ORDER BY id) FILTER (parse_status = 'FAILED' AND k <= 5), '') AS first_messages FROM (SELECT *, row_number() OVER (PARTITION BY project_id, parse_status ORDER BY id) AS k FROM sd) GROUP BY 1")
def parse_summary(spark, d):
    return merge.parse_summary(source_documents(spark, d))


@query(f"WITH {VARIABLES} SELECT project_id, unnest(['NTT', 'SCT', 'SCC']) AS doc_key, id FROM dv WHERE false UNION ALL SELECT project_id, k AS doc_key, id FROM dv, (SELECT unnest(['NTT', 'SCT', 'SCC']) AS k) WHERE coalesce(file_key = k, false) OR list_contains(list_transform(string_split(coalesce(affects, ''), ','), lambda x: trim(x)), k)")
def affects_filter(spark, d):
    v = variables(spark, d)
    keys = F.explode(F.array(*map(F.lit, naming.TEMPLATE_KEYS))).alias("doc_key")
    return v.select("*", keys).where(naming.affects_file(F.col("file_key"), F.col("affects"), F.col("doc_key"))).select("project_id", "doc_key", "id")


@query("""WITH f AS (SELECT unnest(['NTT', 'SCT', 'SCC', 'GCT', 'FT', 'AA', 'GCC', 'SL', 'PRE']) AS file_key), p AS (SELECT DISTINCT source AS project_id FROM documents)
SELECT project_id, file_key, 'VETTING_SUPPLEMENT' AS category, CASE WHEN file_key IN ('NTT', 'SCT', 'SCC') THEN 'GENERATED' ELSE 'PENDING' END AS parse_status, 'role of ' || file_key AS parse_message FROM p, f""")
def seed_pairs(spark, d):
    """Every project with a placeholder for each of the nine files."""
    files = spark.createDataFrame([(k, f"{k}.pdf", f"role of {k}") for k in naming.FILE_ORDER], "file_key string, file_name string, role string")
    return sourceset.placeholders(table(spark, d, "documents").select(F.col("source").alias("project_id")), files).select("project_id", "file_key", "category", "parse_status", "parse_message")


# ---- chunks, retrieval, places


@query("SELECT doc_id, CAST(i AS INTEGER) AS i, substr(text, CAST(i * 680 + 1 AS INTEGER), 800) AS content FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 800 THEN 1 ELSE CAST(ceil((length(text) - 800) / 680.0) AS BIGINT) + 1 END)) AS i FROM documents WHERE length(text) > 0)")
def chunk_hard_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunk.hard_split(F.col("text"))).alias("i", "content"))


@query(f"""WITH {SOURCE_DOCUMENTS}, c AS (SELECT *, unnest(range(0, CASE WHEN length(text_content) <= 800 THEN 1 ELSE CAST(ceil((length(text_content) - 800) / 680.0) AS BIGINT) + 1 END)) AS i, CASE WHEN length(text_content) <= 800 THEN 1 ELSE ceil((length(text_content) - 800) / 680.0) + 1 END AS total FROM sd WHERE length(text_content) > 0)
SELECT project_id, id AS document_id, row_number() OVER (PARTITION BY project_id ORDER BY id, i) - 1 AS chunk_index, coalesce(file_key, '') || ' · ' || file_name AS file_label, CASE WHEN page_count > 1 THEN 'P' || CAST(greatest(1, floor((i + 1) / total * page_count + 0.5)) AS BIGINT) ELSE 'P1' END AS page_no, id || '-' || i AS point_id FROM c""")
def chunk_index(spark, d):
    docs = source_documents(spark, d)
    return chunk.index(docs, chunk.hard_split(F.col("text_content"))).drop("anchor", "content")


#: Chunks of c (id, txt): paragraphs are packed one by one.
_CHUNKS = r"""b AS (SELECT id, list_filter(list_transform(regexp_split_to_array(txt, '\n{2,}'), lambda x: regexp_replace(x, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda x: x <> '') AS bs FROM c),
k(id, i, held, done) AS (SELECT id, 0, '', CAST([] AS VARCHAR[]) FROM b UNION ALL
SELECT k.id, k.i + 1,
  CASE WHEN length(p) > 800 THEN '' WHEN length(held) + length(p) + 2 > 800 THEN right(held, 120) || chr(10) || chr(10) || p || chr(10) || chr(10) ELSE held || p || chr(10) || chr(10) END,
  CASE WHEN length(p) > 800 THEN list_concat(CASE WHEN held <> '' THEN list_append(done, held) ELSE done END, list_transform(range(0, CAST(ceil((length(p) - 800) / 680.0) AS BIGINT) + 1), lambda w: substr(p, w * 680 + 1, 800)))
    WHEN length(held) + length(p) + 2 > 800 THEN list_append(done, held) ELSE done END
FROM (SELECT k.*, b.bs[k.i + 1] AS p, len(b.bs) AS n FROM k JOIN b ON b.id = k.id) k WHERE k.i < k.n),
pieces AS (SELECT k.id, list_filter(list_append(done, held), lambda x: regexp_matches(x, '[^\x00-\x20]')) AS l FROM k JOIN b ON b.id = k.id WHERE k.i = len(b.bs))"""


@query(f"""WITH RECURSIVE c AS (SELECT doc_id AS id, replace(text, chr(10), chr(10) || chr(10)) AS txt FROM documents), {_CHUNKS}
SELECT id AS doc_id, CAST(i AS INTEGER) AS i, md5(regexp_replace(x, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')) AS content FROM (SELECT id, unnest(range(len(l))) AS i, unnest(l) AS x FROM pieces)""".replace("\\\\", "\\"))
def chunk_paragraphs(spark, d):
    paragraphs = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    # windows of a long paragraph keep the blanks at their ends; they are compared without
    return table(spark, d, "documents").select("doc_id", F.posexplode_outer(chunk.split(paragraphs)).alias("i", "content")).where("i IS NOT NULL").withColumn("content", F.md5(text.trim(F.col("content")).cast("binary")))


@query("SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INTEGER % 4 AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point FROM (SELECT doc_id, md5(doc_id || '-0') AS h FROM documents)")
def point_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", chunk.point_uuid(F.concat(F.col("doc_id").cast("string"), F.lit("-0"))).alias("point"))


@query("SELECT source, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS total_chars, sum(length(text)) <= 120000 AS stuffed FROM documents GROUP BY source")
def stuffing_decision(spark, d):
    return search.stuffing(table(spark, d, "documents"), "source", "text", 120_000)


@query(f"""WITH g AS (SELECT label, count(*) <= 50 AS stuffed, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
s AS (SELECT a.label, a.vec_id, stuffed, CASE WHEN stuffed THEN 1.0 ELSE {_COSINE} END AS score FROM embeddings a JOIN g b ON a.label = b.label)
SELECT label, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s WHERE stuffed OR score >= 0.1) WHERE stuffed OR rank <= 20""")
def retrieve_hybrid(spark, d):
    e = table(spark, d, "embeddings").withColumn("content", F.lit("x"))
    queries = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query"))
    return search.retrieve(e, queries, "label", "content", "vec_id", limit=50, threshold=0.1).select("label", "vec_id", F.round("score", 6).alias("score"), "rank")


#: Passages as findings: each is looked for as a whole, then by its sentences; in the documents of one source.
_ASKED = r"""n AS (SELECT finding_id, source, unnest(range(len(l))) AS needle_pos, unnest(l) AS needle FROM (SELECT item_id AS finding_id, 'src' || item_id % 20 AS source,
  list_slice(list_filter(a, lambda x, i: list_position(a, x) = i), 1, 8) AS l FROM (SELECT *, list_concat([text], list_filter(regexp_split_to_array(text, '[.!?]\s*'), lambda x: length(x) >= 5)) AS a FROM benchmark)))"""


def _asked(spark, d) -> DataFrame:
    parts = F.filter(F.split("text", r"[.!?]\s*"), lambda x: F.length(x) >= 5)
    needles = F.slice(F.array_distinct(F.concat(F.array("text"), parts)), 1, 8)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("finding_id"), needles.alias("needles"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"))


#: Where a needle stands in t.text: exactly but for case, else with white space skipped.
_PLACES = r"""p AS (SELECT *, '(?i)' || array_to_string(list_transform(list_filter(string_split(needle, ''), lambda c: NOT regexp_matches(c, '\s')), lambda c: '\s*' || regexp_replace(c, '([^A-Za-z0-9\x{80}-\x{10FFFF}])', '\\\1')), '') AS pattern FROM n WHERE trim(needle) <> ''),
q AS (SELECT finding_id, needle_pos, doc_id, instr(lower(t.text), lower(trim(needle))) AS direct, instr(t.text, regexp_extract(t.text, pattern)) AS loose, regexp_matches(t.text, pattern) AS any_, length(t.text) - length(trim(needle)) AS last FROM p JOIN documents t ON t.source = p.source),
h AS (SELECT finding_id, needle_pos, doc_id, CASE WHEN direct > 0 THEN direct - 1 ELSE loose - 1 END AS idx FROM q WHERE direct > 0 OR (any_ AND loose - 1 <= last))"""


@query(f"""WITH {_ASKED}, {_PLACES},
r AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY needle_pos, doc_id) AS k FROM h) SELECT finding_id, CAST(needle_pos AS INTEGER) AS needle_pos, doc_id, CAST(idx AS INTEGER) AS "index" FROM r WHERE k = 1""")
def locate_evidence(spark, d):
    hits = locate.first_place(_asked(spark, d), table(spark, d, "documents").select("doc_id", "source", "text"), ["source"])
    return hits.select("finding_id", "needle_pos", "doc_id", "index")


@query(f"WITH {_ASKED}, {_PLACES}, r AS (SELECT finding_id, doc_id, row_number() OVER (PARTITION BY finding_id ORDER BY doc_id) AS rank FROM (SELECT DISTINCT finding_id, doc_id FROM h)) SELECT finding_id, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def evidence_top3(spark, d):
    return locate.first_documents(_asked(spark, d), table(spark, d, "documents").select("doc_id", "source", "text"), ["source"]).select("finding_id", "doc_id", "rank")


@query("""WITH l AS (SELECT doc_id, text, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS line FROM (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents)),
m AS (SELECT *, coalesce(sum(10 + length(CAST(k AS VARCHAR)) + length(line)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT doc_id, 'P' || max(k) AS last, 'P' || max(k) FILTER (start <= length(text) // 2) AS middle FROM m GROUP BY 1""")
def page_markers(spark, d):
    """A marker before every line of a text: the page of its end and of a place inside."""
    lines = F.split("text", "\n")
    marked = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("--- P"), (i + 1).cast("string"), F.lit(" ---"), x)), "\n")
    t = table(spark, d, "documents").select("doc_id", marked.alias("t"), F.floor(F.length("text") / 2).cast("int").alias("at"))
    return t.select("doc_id", text.page_at(F.col("t"), F.length("t")).alias("last"), text.page_at(F.col("t"), F.col("at")).alias("middle"))


@query("SELECT e.event_id, m.event_id AS as_of_mark FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1, 2) m ON e.user_id = m.user_id AND e.ts >= m.ts")
def asof_page(spark, d):
    e = table(spark, d, "events")
    marks = e.where("event_type = 'error'").groupBy("user_id", "ts").agg(F.max("event_id").alias("mark"))
    return locate.as_of(e.select("event_id", "user_id", "ts"), marks, "user_id", "ts", "ts", "mark").select("event_id", "as_of_mark")


@query("""WITH s AS (SELECT user_id, event_id AS pos, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 * (1 + event_id % 5) AS b FROM events), p AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, pos ROWS UNBOUNDED PRECEDING) AS island FROM p) SELECT user_id, min(a) AS start, max(b) AS "end", count(*) AS n FROM i GROUP BY user_id, island""")
def merge_spans(spark, d):
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "ts")
    spans = table(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), at.alias("start"), (at + 3_600_000_000 * (1 + F.col("event_id") % 5)).alias("end"))
    return budget.merged_spans(spans, ["user_id"])


#: Words of the synthetic languages, as frequent as a template's markers; one holds another.
_MARKERS = ["the ", "Theand", "ción", "heit", " that", "éle", "he "]
_SPANS = """m AS (SELECT doc_id, text, unnest(range(7)) AS mi, unnest(%s) AS mark FROM documents), o AS (SELECT doc_id, mi, length(text) AS n, length(mark) AS lm, string_split(text, mark) AS l FROM m),
o2 AS (SELECT doc_id, mi, n, unnest(range(1, len(l))) AS k, unnest(list_transform(range(1, len(l)), lambda k: list_sum(list_transform(l[1:k], lambda x: length(x))) + (k - 1) * lm)) AS i FROM o),
o3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mi, k) AS pos FROM o2), o4 AS (SELECT doc_id, pos, greatest(0, i - 300) AS a, least(n, i + 500) AS b FROM o3 WHERE pos <= 400),
o5 AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o4),
o6 AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, pos ROWS UNBOUNDED PRECEDING) AS island FROM o5),
spans AS (SELECT doc_id, min(a) AS start, max(b) AS "end", count(*) AS n FROM o6 GROUP BY doc_id, island)""" % _MARKERS


@query(f"""WITH {_SPANS}, j AS (SELECT d.doc_id, any_value(text) AS text, string_agg(substr(text, CAST(start AS BIGINT) + 1, CAST("end" - start AS BIGINT)), chr(10) || '……（未命中决策线索的正文省略）……' || chr(10) ORDER BY start) AS said FROM documents d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY 1)
SELECT doc_id, {_TRIM.format("CASE WHEN said IS NOT NULL THEN substr(said, 1, 2000) WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '...[已截断]' ELSE text END")} AS focused FROM j""")
def focus_segments(spark, d):
    return budget.focused(table(spark, d, "documents").select("doc_id", "text"), 2000, markers=_MARKERS).select("doc_id", "focused")


_SHARES = f"""{_REVIEWABLE}, tot AS (SELECT project_id, count(*) AS total FROM reviewable GROUP BY 1),
i AS (SELECT project_id, id, length(text_content) AS n, length(coalesce(file_key, '')) + length(file_name) + 21 AS head, row_number() OVER (PARTITION BY project_id ORDER BY place, id) AS nth FROM reviewable),
w(project_id, nth, id, used, cut, rem) AS (SELECT project_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), false, CAST(14000 AS BIGINT) FROM tot
UNION ALL SELECT w.project_id, w.nth + 1, i.id, least(i.n, least(5000, greatest(1200, w.rem // (t.total - w.nth)))), i.n > least(5000, greatest(1200, w.rem // (t.total - w.nth))),
 w.rem - least(i.n, least(5000, greatest(1200, w.rem // (t.total - w.nth)))) - i.head - CASE WHEN i.n > least(5000, greatest(1200, w.rem // (t.total - w.nth))) THEN 9 ELSE 0 END FROM w JOIN i ON i.project_id = w.project_id AND i.nth = w.nth + 1 JOIN tot t ON t.project_id = w.project_id WHERE w.rem > 0)"""


@query(f"WITH RECURSIVE {_SHARES} SELECT project_id, CAST(nth AS INTEGER) AS nth, id, CAST(used AS INTEGER) AS used, cut FROM w WHERE nth > 0")
def budget_alloc(spark, d):
    return budget.review_shares(sourceset.reviewable(source_documents(spark, d)))


# ---- conversations


@query("""WITH q AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next, role FROM conversations),
a AS (SELECT conv_id, turn, text, answer, turn % 4 = 0 AS grounded, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM q WHERE role = 'user' AND next = 'assistant')
SELECT conv_id AS project_id, 2 * nth - 1 AS id, 'user' AS role, NULL AS title, md5(text) AS content, NULL AS unknown_scope, 0 AS cited, NULL AS evidence_id FROM a
UNION ALL SELECT conv_id, 2 * nth, 'assistant', CASE WHEN grounded THEN '带依据的回答' ELSE 'I don''t know' END, CASE WHEN grounded THEN md5(answer) END, CASE WHEN NOT grounded THEN 'fullset' END, 2, 'chunk:T' || turn FROM a""")
def chat_history(spark, d):
    """Questions and answers of conversations as they are logged and read again."""
    c = table(spark, d, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    q = c.withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w)).where("role = 'user' AND next = 'assistant'")
    answers = q.select(F.col("conv_id").alias("project_id"), F.col("turn").alias("pos"), F.col("text").alias("question"), (F.col("turn") % 4 == 0).alias("grounded"), "answer", F.array(F.lit('a "b"'), F.lit("c")).alias("citations"), F.lit("fullset").alias("scope"), F.concat(F.lit("chunk:T"), F.col("turn").cast("string")).alias("evidence_id"))
    none = spark.createDataFrame([], f"project_id {c.schema['conv_id'].dataType.simpleString()}, id long")
    rows = chatlog.history(chatlog.entries(answers, none))
    return rows.select("project_id", "id", "role", "title", F.md5(F.col("content").cast("binary")).alias("content"), "unknown_scope", F.size("citations").alias("cited"), "evidence_id")


@query("WITH f AS (SELECT conv_id, text, min(turn) AS t FROM conversations GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY t, text) AS k FROM f) SELECT conv_id, md5(string_agg(text, '|' ORDER BY k)) AS labels FROM r WHERE k <= 3 GROUP BY conv_id")
def citations_distinct3(spark, d):
    found = search.first_labels(table(spark, d, "conversations"), "conv_id", "text", ["turn"])
    return found.select("conv_id", F.md5(F.array_join("labels", "|").cast("binary")).alias("labels"))


@query("SELECT conv_id, turn, CAST((length(text) - length(replace(text, '%s', ''))) // 2 AS INTEGER) + 2 AS n FROM conversations")
def placeholder_counts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", providers.placeholders(F.concat(F.lit("%s and %%s "), "text")).alias("n"))


@query(f"WITH {VARIABLES} SELECT project_id, var_key, chr(65279) || '# ' || label || chr(10) || chr(10) || value_text AS content FROM dv WHERE true")
def markdown_download(spark, d):
    return variables(spark, d).select("project_id", "var_key", report.download(F.col("label"), F.col("value_text")).alias("content"))


# ---- finders, keys, deletions


@query(f"WITH {SOURCE_DOCUMENTS} SELECT id, project_id, file_key FROM sd WHERE project_id = 'src3' AND category = 'PROJECT_INPUT'")
def find_documents(spark, d):
    docs = source_documents(spark, d).where(search.facets(project_id="src3", category="PROJECT_INPUT"))
    return docs.orderBy("id").select("id", "project_id", "file_key")


@query(f"WITH {SOURCE_DOCUMENTS} SELECT project_id, id, file_key FROM (SELECT *, row_number() OVER (PARTITION BY project_id, file_key ORDER BY id) AS k FROM sd WHERE file_key IS NOT NULL) WHERE k = 1")
def first_by_key(spark, d):
    docs = source_documents(spark, d).where("file_key IS NOT NULL")
    return findings.first_wins(docs, ["project_id", "file_key"], "id").select("project_id", "id", "file_key")


@query(f"WITH {SOURCE_DOCUMENTS} SELECT id FROM sd WHERE parse_status = 'PARSED' AND upper(coalesce(file_key, '')) = 'GCC' AND regexp_matches(text_content, '[^\\x00-\\x20]')".replace("\\\\", "\\"))
def documents_of_file(spark, d):
    return sourceset.of_file(sourceset.readable(source_documents(spark, d)), "gcc").select("id")


@query("SELECT doc_id, printf('VAR-%02d', CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER)) AS var_key FROM documents")
def auto_keys(spark, d):
    return drafting.named(table(spark, d, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("pos"), F.lit(" ").alias("key"))).select(F.col("pos").alias("doc_id"), "var_key")


@query("WITH b AS (SELECT unnest(['contractTitle', 'worksType', 'fundingArrangement', 'billNos', 'subcontractors', 'twoEnvelopeSystem', 'foundationIncluded', 'contractPeriod39Months']) AS var_key, unnest(range(0, 8)) AS sort_order), p AS (SELECT DISTINCT c_nationkey AS project_id FROM customer) SELECT project_id, var_key, CAST(sort_order AS INTEGER) AS sort_order, 'BASE' AS scope, project_id % 3 = 0 AND var_key = 'billNos' AS confirmed FROM p, b")
def ensure_base(spark, d):
    projects = table(spark, d, "customer").select(F.col("c_nationkey").alias("project_id"))
    null = F.lit(None).cast("string")
    stored = projects.where("project_id % 3 = 0").distinct().select("project_id", F.lit("billNos").alias("var_key"), F.lit(99).alias("sort_order"), null.alias("label"), null.alias("action"), null.alias("affects"), F.lit("FILE").alias("scope"), F.lit(True).alias("confirmed"))
    return merge.ensure_base(stored, projects).select("project_id", "var_key", "sort_order", "scope", "confirmed")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def seed_absent(spark, d):
    return merge.absent(table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity > 45").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"]).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey <> 7")
def delete_project(spark, d):
    c = table(spark, d, "customer")
    return merge.without(c, c.where("c_nationkey = 7"), ["c_nationkey"]).select("c_custkey", "c_name")


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def vector_upsert(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    new = e.where("vec_id % 4 = 0").withColumn("label", F.col("label") + 100)
    return merge.replaced(e, new, ["vec_id"])


@query("SELECT p_brand AS group_key, count(*) AS n, min(p_partkey) AS first, md5(string_agg(p_name, '|' ORDER BY p_partkey)) AS items FROM part GROUP BY 1")
def grouped_prompts(spark, d):
    g = search.grouped(table(spark, d, "part"), "p_brand", ["p_partkey"], ["p_name"])
    return g.select(F.col("p_brand").alias("group_key"), "n", F.col("first.p_partkey").alias("first"), F.md5(F.array_join(F.transform("items", lambda x: x["p_name"]), "|").cast("binary")).alias("items"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 <> 0 THEN p_type ELSE p_name END AS body FROM part")
def reset_defaults(spark, d):
    p = table(spark, d, "part")
    defaults = p.where("p_partkey % 3 <> 0").select("p_partkey", F.col("p_type").alias("body"))
    return merge.reset(p.select("p_partkey", F.col("p_name").alias("body"), "p_size"), defaults, ["p_partkey"], F.col("p_size") % 2 == 0).select("p_partkey", "body")


@query("SELECT event_id, CASE WHEN k % 2 = 0 THEN '{\"k\":' || k || '}' ELSE CAST(k AS VARCHAR) END AS said FROM (SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events)")
def lenient_strings(spark, d):
    """A field that should be a string may be an object or a number: it is read as its JSON text."""
    k = F.from_json("props", "k bigint")["k"]
    inner = F.when(k % 2 == 0, F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))).otherwise(k.cast("string"))
    return table(spark, d, "events").select("event_id", jsontext.fields(F.concat(F.lit('{"said": '), inner, F.lit("}")), ["said"])["said"].alias("said"))


@query(f"WITH {VARIABLES} SELECT id, CASE WHEN file_key = 'NTT' THEN 'Tender documents only / 仅招标文件' WHEN file_key = 'SCC' THEN 'Conditions of Contract only / 仅合约条件' ELSE 'Selected package conditions / 选定合约条件' END AS label FROM dv")
def scope_labels(spark, d):
    scope = F.when(F.col("file_key") == "NTT", "tender").when(F.col("file_key") == "SCC", "contract").otherwise("fullset")
    return variables(spark, d).select("id", naming.scope_label(scope).alias("label"))


@query(f"""WITH {SOURCE_DOCUMENTS} SELECT id, 'root/' || project_id || '/' || category || '/' || substr(md5(coalesce(text_content, '')), 1, 8) || '_' || regexp_replace(file_name, '[\\\\/:*?"<>|]', '_', 'g') AS path FROM sd""")
def stored_paths(spark, d):
    docs = source_documents(spark, d)
    return docs.select("id", text.stored_path("root/", F.col("project_id"), F.col("category"), F.col("file_name"), text.nvl(F.col("text_content")).cast("binary")).alias("path"))


@query(r"""WITH w AS (SELECT doc_id, text, doc_id %% 3 = 0 AS poor FROM documents), p AS (SELECT doc_id, poor, 1 AS page_no, CASE WHEN poor THEN '' ELSE text END AS own, text AS seen FROM w UNION ALL SELECT doc_id, poor, 2, CASE WHEN poor THEN ' ' ELSE 'second' END, ' ' FROM w),
t AS (SELECT doc_id, sum(length(CASE WHEN page_no = 1 THEN %(own)s ELSE trim(own) END)) < 80 AS thin FROM p GROUP BY 1),
j AS (SELECT p.doc_id, page_no, CASE WHEN thin AND %(seen)s <> '' THEN seen ELSE %(own)s END AS said, thin AND %(seen)s <> '' AS ocr FROM p JOIN t ON t.doc_id = p.doc_id)
SELECT doc_id, md5(coalesce(%(all)s, '')) AS said, CAST(2 AS INTEGER) AS page_count, bool_or(ocr) AS ocr_used FROM j GROUP BY 1""" % {"own": _NORMAL.format("own"), "seen": _NORMAL.format("seen"), "all": _NORMAL.format(r"string_agg('--- P' || page_no || ' ---' || chr(10) || said || chr(10) || chr(10), '' ORDER BY page_no) FILTER (regexp_matches(said, '[^\x00-\x20]'))")})
def pages_read(spark, d):
    """Pages with a text layer or, for every third document, with none: what was recognised on them counts then."""
    docs, poor = table(spark, d, "documents"), F.col("doc_id") % 3 == 0
    page = lambda n, own: docs.select("doc_id", F.lit(n).alias("page_no"), own.alias("text"))
    pages = page(1, F.when(poor, "").otherwise(F.col("text"))).unionByName(page(2, F.when(poor, " ").otherwise("second")))
    seen = page(1, F.col("text")).unionByName(page(2, F.lit(" ")))
    return files.read_pages(pages, seen).select("doc_id", F.md5(F.col("text_content").cast("binary")).alias("said"), "page_count", "ocr_used")


@query(f"""WITH RECURSIVE {SOURCE_DOCUMENTS}, li AS (SELECT project_id, id, file_name, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT *, regexp_split_to_array(text_content, '\\r?\\n') AS l FROM sd WHERE category = 'PROJECT_INPUT')),
hit AS (SELECT *, {_TRIM.format('line')} AS said FROM li WHERE length({_TRIM.format('line')}) >= 6 AND (""".replace("\\\\", "\\") + " OR ".join(f"contains(lower(line), '{k}')" for k in ["the", "ción", "une", "und"]) + """)),
e AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY id, pos) AS k, CASE WHEN lag(id) OVER (PARTITION BY project_id ORDER BY id, pos) = id THEN '' ELSE chr(10) || '[' || file_name || ']' || chr(10) END AS head, '  ' || said || chr(10) AS entry FROM hit),
r(project_id, k, rem, said) AS (SELECT DISTINCT project_id, CAST(0 AS BIGINT), CAST(4500 AS BIGINT), '' FROM sd UNION ALL
SELECT r.project_id, r.k + 1, greatest(r.rem - length(head) - length(entry), 0), r.said || head || substr(entry, 1, greatest(r.rem - length(head), 0)) FROM r JOIN e ON e.project_id = r.project_id AND e.k = r.k + 1 WHERE r.rem > 0),
z AS (SELECT project_id, arg_max(said, k) AS said FROM r GROUP BY 1) SELECT project_id, CASE WHEN """ + _TRIM.format("said") + " = '' THEN '（无聚焦摘录）' ELSE " + _TRIM.format("said") + " END AS snippets FROM z")
def project_snippets(spark, d):
    return budget.snippets(source_documents(spark, d), keywords=["the", "ción", "une", "und"])


@query(f"""WITH {VARIABLES}, v AS (SELECT * REPLACE (id // 4 AS project_id, CASE WHEN id % 10 = 0 THEN NULL ELSE confirmed END AS confirmed) FROM dv),
k AS (SELECT project_id, unnest(['NTT', 'SCT', 'SCC']) AS doc_key FROM v GROUP BY 1 HAVING bool_and(coalesce(confirmed, false))),
h AS (SELECT k.doc_key AS dk, v.* FROM v JOIN k ON k.project_id = v.project_id WHERE coalesce(file_key = k.doc_key, false) OR list_contains(list_transform(string_split(coalesce(affects, ''), ','), lambda x: trim(x)), k.doc_key)),
p AS (SELECT project_id, dk, string_agg('- **' || label || '**（' || coalesce(action, '') || '）：' || coalesce(value_text, '') || chr(10), '' ORDER BY sort_order, var_key) AS points FROM h GROUP BY 1, 2)
SELECT k.project_id, doc_key, '## ' || CASE doc_key WHEN 'NTT' THEN 'Notes to Tenderers' WHEN 'SCT' THEN 'Special Conditions of Tender' ELSE 'Special Conditions of Contract' END || chr(10) || chr(10) || '**Contract No.** C' || k.project_id || chr(10) || chr(10) ||
 coalesce(points, '') || chr(10) || '> 模型未返回正文，以上为按已确认变量生成的条款要点。' || chr(10) AS content FROM k LEFT JOIN p ON p.project_id = k.project_id AND dk = doc_key""")
def generate_documents(spark, d):
    """Four variables a project; most projects have one that is not confirmed, or was never looked at, and get no document."""
    i = F.col("id")
    v = variables(spark, d).withColumn("project_id", F.floor(i / 4)).withColumn("confirmed", F.when(i % 10 != 0, F.col("confirmed")))
    return drafting.generate(v, F.concat(F.lit("C"), F.col("project_id").cast("string")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' 2' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def patch_rows(spark, d):
    c = table(spark, d, "customer")
    return merge.patch(c, F.col("c_custkey") % 3 == 0, c_mktsegment=F.concat("c_mktsegment", F.lit(" 2")), c_name=None).select("c_custkey", "c_mktsegment")


@query(f'WITH {_SPANS} SELECT doc_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", n FROM spans')
def marker_spans(spark, d):
    return budget.marker_spans(table(spark, d, "documents"), markers=_MARKERS)


@query(f"""WITH RECURSIVE {_READABLE}, tot AS (SELECT project_id, count(*) AS total FROM base GROUP BY 1),
i AS (SELECT project_id, id, length(text_content) AS n, length(file_name) + 11 AS head, row_number() OVER (PARTITION BY project_id ORDER BY id) AS nth FROM base),
w(project_id, nth, id, used, cut, rem) AS (SELECT project_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), false, CAST(8000 AS BIGINT) FROM tot
UNION ALL SELECT project_id, nth, id, least(n, allow), n > allow, rem - least(n, allow) - head - CASE WHEN n > allow THEN 9 ELSE 0 END FROM (SELECT w.project_id, w.nth + 1 AS nth, i.id, i.n, i.head, w.rem, least(greatest(400, w.rem // (t.total - w.nth)), w.rem - i.head) AS allow FROM w JOIN i ON i.project_id = w.project_id AND i.nth = w.nth + 1 JOIN tot t ON t.project_id = w.project_id) WHERE allow > 0)
SELECT project_id, id, CAST(used AS INTEGER) AS used, cut FROM w WHERE nth > 0""")
def evidence_budget(spark, d):
    return budget.evidence_shares(sourceset.readable(source_documents(spark, d)))


@query(f"SELECT doc_id, md5({_TRIM.format('text')}) AS inner_text FROM documents")
def code_fences(spark, d):
    """Whole texts in fences: with a language or none, with words behind the last one or none, and without."""
    i, t = F.col("doc_id") % 4, F.col("text")
    fenced = F.when(i == 0, F.concat(F.lit("```json\n"), t, F.lit("\n```"))).when(i == 1, F.concat(F.lit(" ```\n"), t, F.lit("\n``` that's all"))).when(i == 2, F.concat(F.lit("\n"), t, F.lit(" \n"))).otherwise(F.concat(F.lit("```\n"), t))
    return table(spark, d, "documents").select("doc_id", F.md5(jsontext.strip_fence(fenced).cast("binary")).alias("inner_text"))


@query(f"""WITH {SOURCE_DOCUMENTS}, u AS (SELECT source AS project_id, doc_id AS pos, ['NTT', 'SCT', 'SCC'][doc_id % 3 + 1] AS file_key, ['ntt', 'sct', 'scc'][doc_id % 3 + 1] || '.txt' AS file_name, {_NORMAL.format('text')} AS said FROM documents WHERE text <> ''),
f AS (SELECT project_id, file_key, id AS old, category = 'STANDARD_TEMPLATE' AS own FROM (SELECT *, row_number() OVER (PARTITION BY project_id, file_key ORDER BY id) AS k FROM sd WHERE file_key IS NOT NULL) WHERE k = 1),
b AS (SELECT u.*, old, own FROM u LEFT JOIN f ON f.project_id = u.project_id AND f.file_key = u.file_key),
m AS (SELECT project_id, max(pos) AS pos, file_key, arg_max(file_name, pos) AS file_name, arg_max(said, pos) AS said, any_value(old) AS old FROM b WHERE coalesce(own, true) GROUP BY project_id, file_key),
n AS (SELECT project_id, pos, file_key, file_name, said FROM m WHERE old IS NULL UNION ALL SELECT project_id, pos, file_key, file_name, said FROM b WHERE NOT own),
t AS (SELECT project_id, max(id) AS top FROM sd GROUP BY 1)
SELECT s.project_id, s.id, s.category, s.file_key, coalesce(m.file_name, s.file_name) AS file_name, md5(coalesce(m.said, s.text_content)) AS said FROM sd s LEFT JOIN m ON m.old = s.id AND m.project_id = s.project_id
UNION ALL SELECT n.project_id, coalesce(top, 0) + row_number() OVER (PARTITION BY n.project_id ORDER BY pos), 'STANDARD_TEMPLATE', file_key, file_name, md5(said) FROM n LEFT JOIN t ON t.project_id = n.project_id""")
def upload_templates(spark, d):
    """Each text is sent as a template's file to the project of its source."""
    names = one_of(["ntt.txt", "sct.txt", "scc.txt"], F.col("doc_id") % 3)
    files = table(spark, d, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("pos"), names.alias("file_name"), F.col("text").cast("binary").alias("content"))
    done = upload.templates(source_documents(spark, d), upload.received(files, upload.TEMPLATE, "root"))
    return done.select("project_id", "id", "category", "file_key", "file_name", F.md5(F.col("text_content").cast("binary")).alias("said"))


# ---- whole flows, on stand-in providers


_WHOLE = r"CASE WHEN length({0}) >= 5 THEN [{0}] ELSE [] END, list_filter(list_transform(regexp_split_to_array({0}, '[·→↔|,;\s\x0B]+'), lambda t: " + _TRIM.format("t") + "), lambda t: length(t) >= 5)"
_NEEDLED = "list_concat(" + ", ".join(f"list_concat({_WHOLE.format(c)})" for c in ("q0", "location", "refs")) + ")"
_RUN = rf"""{ACCEPTED}, {_REVIEWABLE}, a0 AS (SELECT *, {_TRIM.format("quote")} AS q0 FROM accepted), a1 AS (SELECT *, {_NEEDLED} AS a FROM a0),
a2 AS (SELECT project_id, code, file_key, unnest(range(len(l))) AS needle_pos, unnest(l) AS needle FROM (SELECT *, list_slice(list_filter(a, lambda x, i: list_position(a, x) = i), 1, 8) AS l FROM a1)),
a3 AS (SELECT *, '(?i)' || array_to_string(list_transform(list_filter(string_split(needle, ''), lambda c: NOT regexp_matches(c, '\s')), lambda c: '\s*' || regexp_replace(c, '([^A-Za-z0-9\x{{80}}-\x{{10FFFF}}])', '\\\1')), '') AS pattern FROM a2),
a4 AS (SELECT n.project_id, code, needle_pos, t.place, t.id, instr(lower(t.text_content), lower(needle)) AS direct, instr(t.text_content, regexp_extract(t.text_content, pattern)) AS loose, regexp_matches(t.text_content, pattern) AS any_, length(t.text_content) - length(needle) AS last
  FROM a3 n JOIN reviewable t ON t.project_id = n.project_id AND (n.file_key IS NULL OR t.file_key = n.file_key)),
a5 AS (SELECT *, CASE WHEN direct > 0 THEN direct - 1 ELSE loose - 1 END AS idx, row_number() OVER (PARTITION BY project_id, code ORDER BY needle_pos, place, id) AS k FROM a4 WHERE direct > 0 OR (any_ AND loose - 1 <= last)),
a6 AS (SELECT h.project_id, code, h.id, 'P' || list_last(regexp_extract_all(substr(t.text_content, 1, CAST(idx AS BIGINT)), '---\s*P(\d+)\s*---', 1)) AS page FROM a5 h JOIN reviewable t ON t.project_id = h.project_id AND t.id = h.id WHERE k = 1),
found AS (SELECT a.* EXCLUDE (page_no), CASE WHEN h.id IS NULL THEN 'unverified' ELSE 'doc:' || h.id || ':' || coalesce(page, '') END AS evidence_id, coalesce(page, CASE WHEN trim(coalesce(a.page_no, '')) = '' THEN 'P1' ELSE a.page_no END) AS page_no, 'Open' AS status
  FROM accepted a LEFT JOIN a6 h ON h.project_id = a.project_id AND h.code = a.code)"""


@query(f"WITH {_RUN} SELECT * FROM found")
def vetting_run(spark, d):
    return vetting.run(records(spark, d), source_documents(spark, d))


@query(f"WITH {_RUN}, b AS (SELECT project_id, count(*) AS said, count(*) FILTER (trim(types) = '') AS blank FROM rec GROUP BY 1), c AS (SELECT project_id, count(*) AS n, count(*) FILTER (group_key = 'risk' AND r > 10) AS over_cap FROM capped GROUP BY 1), k AS (SELECT project_id, count(*) AS kept, count(*) FILTER (evidence_id = 'unverified') AS unverified FROM found GROUP BY 1) SELECT b.project_id, said, blank, said - blank - coalesce(n, 0) AS repeated, coalesce(over_cap, 0) AS over_cap, coalesce(kept, 0) AS kept, coalesce(unverified, 0) AS unverified FROM b LEFT JOIN c ON b.project_id = c.project_id LEFT JOIN k ON b.project_id = k.project_id")
def vetting_summary(spark, d):
    said = records(spark, d)
    return vetting.summary(vetting.run(said, source_documents(spark, d)), said)


@query(f"WITH {_RUN} SELECT project_id, code, group_key, page_no FROM found WHERE group_key = 'conflict' AND scope = 'inter' AND (contains(lower(title), 'on') OR contains(lower(quote), 'on') OR contains(lower(code), 'on') OR contains(lower(refs), 'on') OR contains(lower(expected), 'on') OR contains(lower(location), 'on') OR contains(lower(types), 'on') OR contains(lower(coalesce(file_key, '')), 'on'))")
def vetting_list(spark, d):
    found = vetting.run(records(spark, d), source_documents(spark, d))
    return vetting.listed(found, " ON ", group="conflict", scope="inter", file_key="all").select("project_id", "code", "group_key", "page_no")


@query(f"WITH {_RUN} SELECT f.project_id, code, s.id AS document_id, s.file_name, nullif(split_part(f.evidence_id, ':', 3), '') AS page FROM found f JOIN sd s ON starts_with(f.evidence_id, 'doc:' || s.id || ':') AND s.project_id = f.project_id")
def evidence_lookup(spark, d):
    docs = source_documents(spark, d)
    return vetting.document_of(vetting.run(records(spark, d), docs), docs).select("project_id", "code", "document_id", "file_name", F.nullif("page", F.lit("")).alias("page"))


@query(f"""WITH {ACCEPTED}, m AS (SELECT project_id, count(*) FILTER (group_key = 'reference') AS reference, count(*) FILTER (group_key = 'conflict') AS conflict, count(*) FILTER (group_key = 'language') AS language, count(*) FILTER (group_key = 'risk') AS risk, count(*) AS total, count(*) FILTER (scope = 'inter') AS cross_file FROM accepted GROUP BY 1),
r AS (SELECT *, coalesce(lag(group_key) OVER (PARTITION BY project_id ORDER BY code) <> group_key, true) AS header FROM accepted)
SELECT project_id, '' AS code, 0 AS part, 'cover' AS kind, 'reference=' || reference || ' conflict=' || conflict || ' language=' || language || ' risk=' || risk || ' total=' || total || ' cross_file=' || cross_file AS said FROM m
UNION ALL SELECT r.project_id, code, 1, 'header', group_key || ' ' || CASE group_key WHEN 'reference' THEN reference WHEN 'conflict' THEN conflict WHEN 'language' THEN language ELSE risk END FROM r JOIN m ON m.project_id = r.project_id WHERE header
UNION ALL SELECT project_id, code, 2, 'card', concat_ws(' | ', code, severity, location, refs, title, page_no) FROM r""")
def report_export(spark, d):
    return vetting.export(findings.accept(records(spark, d)))


@query(f"""WITH RECURSIVE {_SHARES} SELECT w.project_id, string_agg(chr(10) || chr(10) || '===== 文件：' || coalesce(r.file_key, '') || ' · ' || r.file_name || ' =====' || chr(10) || substr(r.text_content, 1, w.used) || CASE WHEN cut THEN chr(10) || '...[已截断]' ELSE '' END, '' ORDER BY w.nth) AS payload FROM w JOIN reviewable r ON r.id = w.id AND r.project_id = w.project_id WHERE w.nth > 0 GROUP BY 1""")
def vetting_payload(spark, d):
    return vetting.payload(source_documents(spark, d))


@query(f"""WITH RECURSIVE {SOURCE_DOCUMENTS}, c AS (SELECT id, text_content AS txt FROM sd WHERE {_TRIM.format("text_content")} <> ''), {_CHUNKS}, u AS (SELECT id, len(l) AS total, unnest(range(len(l))) AS i FROM pieces)
SELECT project_id, u.id AS document_id, row_number() OVER (PARTITION BY project_id ORDER BY u.id, i) - 1 AS chunk_index, CASE WHEN page_count > 1 THEN 'P' || CAST(greatest(1, floor((i + 1) / total * page_count + 0.5)) AS BIGINT) ELSE 'P1' END AS page_no, u.id || '-' || i AS point_id, CAST(64 AS INTEGER) AS dim FROM u JOIN sd ON sd.id = u.id""")
def rebuild_index(spark, d):
    return advice.rebuild_index(source_documents(spark, d)).select("project_id", "document_id", "chunk_index", "page_no", "point_id", F.size("embedding").alias("dim"))


def _said(prompt: str) -> str:
    """A stand-in for a model: what it says hangs on the prompt's digest; one in sixteen calls fails."""
    h = hashlib.md5(prompt.encode()).hexdigest()
    if h[0] == "f":
        raise OSError("no connection")
    return json.dumps({"grounded": h[0] not in "01", "answer": h, "citations": ["C 1", "C 2"] if h[0] in "23" else [], "missingReason": "nothing said" if h[0] == "0" else None})


@query(f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
q AS (SELECT conv_id, {_TRIM.format("coalesce(arg_min(text, turn) FILTER (role = 'user'), '')")} AS question, CASE conv_id % 3 WHEN 0 THEN 'tender' WHEN 1 THEN 'contract' ELSE 'fullset' END AS scope FROM c GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, 'T' || (turn // 4) AS label FROM c WHERE role = 'assistant'),
x AS (SELECT conv_id, string_agg('[' || n || '] ' || label || '  P' || turn || '  ' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS excerpts, list(label ORDER BY n) AS ls FROM k GROUP BY 1),
p AS (SELECT q.*, ls, list_slice(list_filter(ls, lambda v, i: list_position(ls, v) = i), 1, 3) AS labels,
  md5('Scope: ' || CASE scope WHEN 'tender' THEN 'Tender documents only / 仅招标文件' WHEN 'contract' THEN 'Conditions of Contract only / 仅合约条件' ELSE 'Selected package conditions / 选定合约条件' END || chr(10) || chr(10) || excerpts || chr(10) || chr(10) || 'Question: ' || question || '{providers.JSON_ONLY}') AS h FROM q LEFT JOIN x ON x.conv_id = q.conv_id),
e AS (SELECT *, CASE WHEN question = '' THEN 4202 WHEN ls IS NULL THEN 4204 WHEN h[1] = 'f' THEN 4203 END AS error, h[1] NOT IN ('0', '1') AS sure FROM p)
SELECT conv_id AS project_id, md5(question) AS question, scope, CASE WHEN error IS NULL THEN sure END AS grounded, CASE WHEN error IS NULL THEN CASE WHEN sure THEN '带依据的回答' ELSE 'I don''t know' END END AS title,
  CASE WHEN error IS NULL AND sure THEN h END AS answer, CASE WHEN error IS NULL AND NOT sure THEN scope END AS unknown_scope,
  CASE WHEN error IS NULL THEN CASE WHEN h[1] IN ('2', '3') THEN ['C 1', 'C 2'] WHEN h[1] = '0' THEN list_append(labels, 'nothing said') ELSE labels END END AS citations,
  CASE WHEN error IS NULL THEN 'chunk:' || ls[1] END AS evidence_id, CAST(CASE WHEN error IS NULL THEN len(ls) END AS INTEGER) AS n_sources, CAST(error AS INTEGER) AS error FROM e""")
def ask(spark, d):
    """The first thing that a user says, answered from all that the assistant said in the conversation."""
    c = table(spark, d, "conversations").withColumn("project_id", F.col("conv_id"))
    turn = F.col("turn").cast("string")
    chunks = c.where("role = 'assistant'").select("project_id", F.col("turn").alias("chunk_index"), F.concat(F.lit("T"), F.floor(F.col("turn") / 4).cast("string")).alias("file_label"), F.concat(F.lit("P"), turn).alias("page_no"), F.lit(None).cast("string").alias("anchor"), F.col("text").alias("content"), F.array().cast("array<float>").alias("embedding"))
    questions = c.groupBy("project_id").agg(F.min_by(F.when(F.col("role") == "user", text.nvl(F.col("text"))), F.when(F.col("role") == "user", F.col("turn"))).alias("question"))
    questions = questions.withColumn("scope", one_of(["tender", "contract", " "], F.col("project_id") % 3))
    got = advice.ask(questions, chunks, _said)
    return got.select("project_id", F.md5(F.col("question").cast("binary")).alias("question"), "scope", "grounded", "title", "answer", "unknown_scope", "citations", "evidence_id", F.when(F.col("error").isNull(), F.size("sources")).alias("n_sources"), "error")


_SPEC = [(k, i, label, action, kind, files) for i, (k, label, action, _, kind, files) in enumerate(naming.BASE_VARIABLES)]
_SAID = ["yes", "Tender B", "x\\ny", None, "No"]


def _found(spark, d) -> DataFrame:
    """customer as a model's variables: some of the fixed ones, some of its own, some again and again, some without a key."""
    i = F.col("c_custkey")
    keys = [k for k, *_ in naming.BASE_VARIABLES]
    return table(spark, d, "customer").select(
        F.col("c_nationkey").alias("project_id"),
        i.alias("pos"),
        F.when(i % 4 == 0, one_of(keys, F.floor(i / 4) % len(keys))).when(i % 17 == 0, " ").when(i % 11 == 1, F.concat(F.lit("R "), (i % 3).cast("string"))).otherwise(F.concat(F.lit("K"), i.cast("string"))).alias("key"),
        one_of(["Base", "FILE", None], i % 3).alias("scope"),
        one_of([" ntt", "SCT", None, "zzz"], i % 4).alias("file_key"),
        F.col("c_name").alias("label"),
        one_of(["Choice", "fill", " DELETE ", "odd", None], i % 5).alias("action"),
        F.array().cast("array<string>").alias("options"),
        F.lit("NTT,scc").alias("affects"),
        one_of(_SAID, i % 5).alias("value"),
        F.col("c_mktsegment").alias("source"),
        (0.5 + (i % 6) / 10).alias("confidence"),
    )


@query(f"""WITH {VARIABLES}, b AS (SELECT unnest({[k for k, *_ in _SPEC]}) AS base, unnest(range({len(_SPEC)})) AS i, unnest({[x[2] for x in _SPEC]}) AS base_label, unnest({[x[3] for x in _SPEC]}) AS base_action, unnest([{', '.join('NULL' if x[4] is None else repr(x[4]) for x in _SPEC)}]) AS base_kind, unnest({[x[5] for x in _SPEC]}) AS base_affects),
f AS (SELECT c_nationkey AS project_id, c_custkey AS pos, CASE WHEN c_custkey % 4 = 0 THEN (SELECT base FROM b WHERE i = (c_custkey // 4) % {len(_SPEC)}) WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 11 = 1 THEN 'R' || (c_custkey % 3) ELSE 'K' || c_custkey END AS k0,
  {sql_one_of(['Base', 'FILE', None], 'c_custkey % 3')} AS said_scope, {sql_one_of(['NTT', 'SCT', None, None], 'c_custkey % 4')} AS file_key, c_name AS label, {sql_one_of(['choice', 'fill', 'delete', 'fill', 'fill'], 'c_custkey % 5')} AS action,
  coalesce({sql_one_of(_SAID, 'c_custkey % 5')}, '') AS v, c_mktsegment AS source, c_custkey % 6 >= 2 AS likely FROM customer),
g AS (SELECT * EXCLUDE (k0), CASE WHEN k0 = '' THEN printf('VAR-%02d', CAST(row_number() OVER (PARTITION BY project_id, k0 ORDER BY pos) AS INTEGER)) ELSE k0 END AS var_key FROM f),
j AS (SELECT g.*, b.* FROM g LEFT JOIN b ON lower(var_key) = lower(base) WHERE (likely OR base IS NOT NULL) AND NOT (coalesce(said_scope, '') = 'Base' AND base IS NULL)),
u AS (SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM dv WHERE dv.project_id = j.project_id AND dv.var_key = j.var_key AND dv.confirmed)),
o AS (SELECT *, CASE WHEN base IS NULL THEN 999 + row_number() OVER (PARTITION BY project_id, base IS NULL ORDER BY pos) ELSE i END AS place, row_number() OVER (PARTITION BY project_id, var_key ORDER BY pos DESC) AS last FROM u),
w AS (SELECT project_id, var_key, CASE WHEN base_kind = 'list' THEN CASE WHEN v = '' THEN '[]' ELSE '["' || replace(v, '\\n', '","') || '"]' END ELSE v END AS value_text,
  CASE WHEN base IS NULL THEN CASE WHEN action = 'choice' THEN v END WHEN base_action <> 'choice' OR v = '' THEN NULL WHEN base = 'fundingArrangement' THEN CASE WHEN v = 'Tender B' THEN v ELSE 'Tender A' END WHEN v = 'No' THEN '否' ELSE '是' END AS choice,
  source AS source_ref, coalesce(base_label, label) AS label, coalesce(base_action, action) AS action, coalesce(base_affects, 'NTT,SCC') AS affects, base_kind AS kind, CASE WHEN base IS NULL THEN file_key END AS file_key, place AS sort_order, CASE WHEN base IS NULL THEN 'FILE' ELSE 'BASE' END AS scope FROM o WHERE last = 1),
h AS (SELECT project_id, var_key, value_text, NULL AS choice, NULL AS source_ref, label, action, affects, NULL AS kind, file_key, sort_order, scope, confirmed FROM dv
  UNION ALL SELECT project_id, base, NULL, NULL, NULL, base_label, base_action, base_affects, base_kind, NULL, i, 'BASE', false FROM (SELECT DISTINCT project_id FROM dv), b),
kept AS (SELECT h.*, 'kept' AS outcome FROM h LEFT JOIN w ON w.project_id = h.project_id AND w.var_key = h.var_key WHERE confirmed OR (w.var_key IS NULL AND h.scope = 'BASE')),
taken AS (SELECT w.*, false AS confirmed, CASE WHEN h.var_key IS NULL THEN 'inserted' ELSE 'updated' END AS outcome FROM w LEFT JOIN h ON w.project_id = h.project_id AND w.var_key = h.var_key)
SELECT project_id, var_key, value_text, choice, source_ref, label, action, affects, kind, file_key, CAST(sort_order AS INTEGER) AS sort_order, scope, confirmed, outcome FROM kept
UNION ALL SELECT project_id, var_key, value_text, choice, source_ref, label, action, affects, kind, file_key, CAST(sort_order AS INTEGER), scope, confirmed, outcome FROM taken""")
def extract_variables(spark, d):
    stored = variables(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("choice", "source_ref", "kind")}).drop("id")
    return drafting.reconcile(_found(spark, d), stored)
