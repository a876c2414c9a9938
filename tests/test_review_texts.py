"""What the review's step costs: places once for a needle, texts by their ids, findings without a join."""

import re

import pytest
from pyspark.sql import functions as F

from parchment.functions import text
from parchment.operators import sourceset
from parchment.plans import vetting
from parchment.queries.derived import records, source_documents
from tests.oracle import DATA


def exchanges(node):
    own = [(node.simpleString(100), node.output().mkString(" "))] if node.nodeName() == "Exchange" else []
    return own + [x for i in range(node.children().size()) for x in exchanges(node.children().apply(i))]


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan()
    return exchanges(plan.initialPlan() if "Adaptive" in plan.nodeName() else plan)


def test_a_place_is_looked_for_once(spark):
    """Not once for each marker: what finds it stands outside of the filter of markers, where Spark allows no Python function."""
    where = F.udf(lambda s: s.find("here"), "int")
    df = spark.createDataFrame([(1, "--- P1 ---\nx\n--- P2 ---\nhere\n--- P3 ---\ny"), (2, "here\n--- P1 ---"), (3, "here")], "id int, text string")
    got = df.select("id", text.page_in(text.page_marks(F.col("text")), where("text")).alias("page")).orderBy("id").collect()
    assert [r["page"] for r in got] == ["P2", None, None]


def test_blank_is_what_trim_leaves_nothing_of(spark):
    said = ["", " ", "\n", "\x00\t \r\n", " ", "  ", "　", "a", " a\n", "\x1f\x20", "\x21", "\x85", None]
    df = spark.createDataFrame([(s,) for s in said], "s string").select(text.is_blank(F.col("s")).alias("a"), (text.trim(text.nvl(F.col("s"))) == "").alias("b"))
    assert [r["a"] for r in df.collect()] == [r["b"] for r in df.collect()] == [all(c <= " " for c in s or "") for s in said]


@pytest.fixture
def large(spark):
    """Plans as for tables that are too large to be sent to all tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_not_dealt_by_project(spark, large):
    """One project may have most of the texts."""
    dealt = shuffles(sourceset.reviewable(source_documents(spark, DATA)))
    assert any("text_content" in out for _, out in dealt)
    assert all(re.search(r"hashpartitioning\(.*\bid#", said) for said, out in dealt if "text_content" in out)


def test_records_without_a_join(spark, large):
    rows = records(spark, DATA)
    assert shuffles(rows) == []
    own = source_documents(spark, DATA).select(F.col("id").alias("pos"), F.lower("file_key").alias("own"))
    named = rows.where("pos % 5 < 2").join(own, "pos")
    assert named.count() > 0 and named.where(~F.col("file_key").eqNullSafe(F.col("own"))).isEmpty()


def test_run_with_many_markers(spark):
    """A place in a text with many markers; a finding whose file is not reviewed; one project without documents."""
    pages = "\n".join(f"--- P{i} ---\nline {i} of the clause" for i in range(1, 200))
    docs = spark.createDataFrame([(1, "p", "VETTING_SUPPLEMENT", "NTT", "PARSED", pages), (2, "p", "VETTING_SUPPLEMENT", "NTT", "PARSED", "short"), (3, "p", "VETTING_SUPPLEMENT", None, "PARSED", "line 7 of something else"), (4, "p", "VETTING_SUPPLEMENT", "SCT", "PARSED", " \n")], "id long, project_id string, category string, file_key string, parse_status string, text_content string")
    schema = "project_id string, pos long, types string, refs string, location string, title string, quote string, scope string, severity string, file_key string, bucket_key string, expected string, page_no string"
    said = [("p", 1, "f2-i", "", "", "a", "line 150 of  THE clause", None, None, "ntt", None, "", None), ("p", 2, "f2-i", "", "", "b", "line 7 of something", None, None, None, None, "", "P9"), ("p", 3, "f2-i", "", "", "c", "line 150 of the clause", None, None, "sct", None, "", None), ("q", 4, "f2-i", "", "", "d", "line 150", None, None, None, None, "", None)]
    got = vetting.run(spark.createDataFrame(said, schema), docs).select("project_id", "pos", "evidence_id", "page_no").orderBy("pos").collect()
    assert [(r["pos"], r["evidence_id"], r["page_no"]) for r in got] == [(1, "doc:1:P150", "P150"), (2, "unverified", "P9"), (3, "unverified", "P1"), (4, "unverified", "P1")]
