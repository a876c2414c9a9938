"""Contract-shaped tables that Spark derives from the driver's tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions.naming import match_file_key

#: Names that hold a key, or none.
FILE_NAMES = [
    "tender notes NTT r2.docx",
    "rules of tender SCT.docx",
    "our SCC, revised.docx",
    "GCT 2020.pdf",
    "FT to be filled.pdf",
    "AA for signing.pdf",
    "main GCC.pdf",
    "specification of works.pdf",
    "opening bills PRE.docx",
    "Draft.pdf",
    "Translation.docx",
    "memo.txt",
    "letter.eml",
    "minutes.msg",
]
PLAIN_NAMES = ["memo.txt", "letter.eml", "minutes.msg", "scan.tif"]
#: By the number in a project's name: one with packages, two with neither packages nor known files, one of inputs only.
CATEGORIES = [
    ["STANDARD_TEMPLATE", "PROJECT_INPUT", "VETTING_PACKAGE", "VETTING_SUPPLEMENT"],
    ["STANDARD_TEMPLATE", "PROJECT_INPUT", "PROJECT_INPUT", "VETTING_SUPPLEMENT"],
    ["STANDARD_TEMPLATE", "PROJECT_INPUT", "PROJECT_INPUT", "VETTING_SUPPLEMENT"],
    ["PROJECT_INPUT", "PROJECT_INPUT", "VETTING_SUPPLEMENT", "VETTING_SUPPLEMENT"],
]
TYPES = ["f2-i", "f2-ii", "f2-iii,f2-v", "f2-iv", " f2-v", "f2-vi,f2-ii", "f2-vii", "f2-viii", "f2-ix", " "]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_of(values: list, index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def sql_one_of(values: list, index: str) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][CAST({index} AS INTEGER) + 1]"


def _names(i, j, shape):
    return F.when(shape < 2, one_of(FILE_NAMES, (i + j) % 14)).otherwise(one_of(PLAIN_NAMES, j % 4))


def _shape():
    return F.coalesce(F.regexp_extract("source", "([0-9]+)", 1).try_cast("int"), F.lit(0)) % 4


def paged(c: F.Column) -> F.Column:
    """A text with a page's mark before every third line."""
    mark = lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("--- P"), F.floor((i + 1) / 3).cast("string"), F.lit(" ---\n"), x)).otherwise(x)
    return F.array_join(F.transform(F.split(c, "\n"), mark), "\n")


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source_document: a project is a source."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    j = F.floor(i / 20)
    shape = _shape()
    category = one_of(CATEGORIES[0], j % 4)
    for n in (1, 2, 3):
        category = F.when(shape == n, one_of(CATEGORIES[n], j % 4)).otherwise(category)
    rows = d.select(
        i.alias("id"),
        F.col("source").alias("project_id"),
        category.alias("category"),
        _names(i, j, shape).alias("file_name"),
        F.when(j % 7 == 1, "FAILED").when(j % 7 == 2, "PENDING").otherwise("PARSED").alias("parse_status"),
        (1 + i % 12).cast("int").alias("page_count"),
        F.when(j % 11 == 5, F.lit(" \n")).otherwise(paged(F.col("text"))).alias("text_content"),
    )
    return rows.withColumn("file_key", match_file_key(F.col("file_name")))


_KEY = "CASE " + " ".join(f"WHEN contains(upper(file_name), '{k}') THEN '{k}'" for k in ("NTT", "SCT", "SCC", "GCT", "FT", "AA", "GCC", "SL", "PRE")) + " WHEN contains(upper(file_name), 'TENDERER') THEN 'NTT' WHEN contains(upper(file_name), 'SPECIFICATION') THEN 'SL' END"
_SHAPED = "(SELECT *, doc_id // 20 AS j, coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER), 0) % 4 AS shape FROM documents)"
_FILE_NAME = f"CASE WHEN shape < 2 THEN {sql_one_of(FILE_NAMES, '(doc_id + j) % 14')} ELSE {sql_one_of(PLAIN_NAMES, 'j % 4')} END"
SOURCE_DOCUMENTS = f"""sd AS (SELECT *, {_KEY} AS file_key FROM (SELECT doc_id AS id, source AS project_id,
  CASE shape WHEN 0 THEN {sql_one_of(CATEGORIES[0], 'j % 4')} WHEN 3 THEN {sql_one_of(CATEGORIES[3], 'j % 4')} ELSE {sql_one_of(CATEGORIES[1], 'j % 4')} END AS category,
  {_FILE_NAME} AS file_name, CASE WHEN j % 7 = 1 THEN 'FAILED' WHEN j % 7 = 2 THEN 'PENDING' ELSE 'PARSED' END AS parse_status,
  CAST(1 + doc_id % 12 AS INTEGER) AS page_count, CASE WHEN j % 11 = 5 THEN ' ' || chr(10) ELSE array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 0 THEN '--- P' || (i // 3) || ' ---' || chr(10) || x ELSE x END), chr(10)) END AS text_content FROM {_SHAPED}))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a model's review findings, in order of doc_id: the title is a text's first line, the quote stands in its
    middle, most name the document's own file."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    # (as source_documents() has it; without a join, which would shuffle the texts)
    named = d.withColumn("file_name", _names(i, F.floor(i / 20), _shape()))
    return named.withColumn("own", F.lower(match_file_key(F.col("file_name")))).select(
        F.col("source").alias("project_id"),
        i.alias("pos"),
        one_of(TYPES, F.floor(i / 20) % 10).alias("types"),
        F.concat(F.lit("NTT 3(b) → SCT"), (i % 6).cast("string")).alias("refs"),
        F.concat(F.lit("SCC "), (i % 3).cast("string"), F.lit(".1")).alias("location"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("title"),
        F.substring(F.col("text"), F.floor(F.length("text") / 2).cast("int") + 1, F.lit(60)).alias("quote"),
        one_of(["intra", "inter", None], i % 3).alias("scope"),
        one_of(["HIGH", "low", "odd", None], i % 4).alias("severity"),
        F.when(i % 5 == 2, " ntt ").when(i % 5 == 3, "zzz").when(i % 5 != 4, F.col("own")).alias("file_key"),
        one_of([" own ", "", None], i % 3).alias("bucket_key"),
        F.col("lang").alias("expected"),
        one_of(["P2", "", None], F.floor(i / 20) % 3).alias("page_no"),
    )


RECORDS = f"""rec AS (SELECT source AS project_id, doc_id AS pos, {sql_one_of(TYPES, 'j % 10')} AS types, 'NTT 3(b) → SCT' || (doc_id % 6) AS refs,
  'SCC ' || (doc_id % 3) || '.1' AS location, string_split(text, chr(10))[1] AS title, substr(text, CAST(length(text) // 2 AS BIGINT) + 1, 60) AS quote, {sql_one_of(['intra', 'inter', None], 'doc_id % 3')} AS scope,
  {sql_one_of(['HIGH', 'low', 'odd', None], 'doc_id % 4')} AS severity, CASE doc_id % 5 WHEN 2 THEN ' ntt ' WHEN 3 THEN 'zzz' WHEN 4 THEN NULL ELSE lower({_KEY}) END AS file_key,
  {sql_one_of([' own ', '', None], 'doc_id % 3')} AS bucket_key, lang AS expected, {sql_one_of(['P2', '', None], 'j % 3')} AS page_no FROM (SELECT *, {_FILE_NAME} AS file_name FROM {_SHAPED}))"""
GROUP = "CASE " + " ".join(f"WHEN list_contains(ts, '{t}') THEN '{g}'" for t, g in (("f2-iii", "reference"), ("f2-iv", "reference"), ("f2-i", "conflict"), ("f2-vi", "conflict"), ("f2-viii", "conflict"), ("f2-ix", "language"), ("f2-v", "language"))) + " ELSE 'risk' END"
#: typed: not blank, with its key; single: first of each; kept: under the cap, numbered.
ACCEPTED = (
    RECORDS
    + r""", typed AS (SELECT *, regexp_replace(lower(types || '|' || refs || '|' || location || '|' || title || '|' || substr(quote, 1, 120)), '[\s\x0B]+', '', 'g') AS dk,
  list_transform(string_split(types, ','), lambda x: trim(x)) AS ts FROM rec WHERE trim(types) <> ''),
single AS (SELECT *, """
    + GROUP
    + """ AS group_key FROM (SELECT *, row_number() OVER (PARTITION BY project_id, dk ORDER BY pos) AS k FROM typed) WHERE k = 1),
capped AS (SELECT *, sum(CASE WHEN group_key = 'risk' THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM single),
kept AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pos) AS nth FROM capped WHERE group_key <> 'risk' OR r <= 10),
accepted AS (SELECT project_id, pos, 'VT-' || CASE WHEN nth < 1000 THEN lpad(CAST(nth AS VARCHAR), 3, '0') ELSE CAST(nth AS VARCHAR) END AS code, types, group_key,
  CASE WHEN scope = 'intra' THEN 'intra' ELSE 'inter' END AS scope, CASE WHEN lower(severity) IN ('high', 'medium', 'low') THEN lower(severity) ELSE 'medium' END AS severity,
  CASE WHEN upper(file_key) IN ('NTT', 'SCT', 'SCC', 'GCT', 'FT', 'AA', 'GCC', 'SL', 'PRE') THEN upper(file_key) END AS file_key,
  CASE WHEN trim(coalesce(bucket_key, '')) <> '' THEN trim(bucket_key) WHEN group_key = 'reference' THEN 'missing' WHEN group_key = 'language' THEN 'grammar' WHEN group_key = 'conflict' THEN 'particulars' ELSE 'scope' END AS bucket_key,
  title, substr(quote, 1, 480) AS quote, substr(refs, 1, 500) AS refs, substr(location, 1, 500) AS location, substr(expected, 1, 500) AS expected, page_no FROM kept)"""
)


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as stored draft variables: a project is a nation."""
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        F.col("c_nationkey").alias("project_id"),
        i.alias("id"),
        F.concat(F.lit("K"), i.cast("string")).alias("var_key"),
        F.when(i % 3 == 0, "BASE").otherwise("FILE").alias("scope"),
        one_of(["NTT", "SCT", "SCC", None], i % 4).alias("file_key"),
        F.col("c_mktsegment").alias("value_text"),
        F.col("c_name").alias("label"),
        one_of(["fill", "choice", None], i % 3).alias("action"),
        one_of(["NTT,SCC", " sct , scc", "", None], i % 4).alias("affects"),
        (i % 5 != 0).alias("confirmed"),
        i.cast("int").alias("sort_order"),
    )


VARIABLES = f"""dv AS (SELECT c_nationkey AS project_id, c_custkey AS id, 'K' || c_custkey AS var_key, CASE WHEN c_custkey % 3 = 0 THEN 'BASE' ELSE 'FILE' END AS scope,
  {sql_one_of(['NTT', 'SCT', 'SCC', None], 'c_custkey % 4')} AS file_key, c_mktsegment AS value_text, c_name AS label, {sql_one_of(['fill', 'choice', None], 'c_custkey % 3')} AS action,
  {sql_one_of(['NTT,SCC', ' sct , scc', '', None], 'c_custkey % 4')} AS affects, c_custkey % 5 <> 0 AS confirmed, CAST(c_custkey AS INTEGER) AS sort_order FROM customer)"""
