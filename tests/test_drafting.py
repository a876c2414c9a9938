"""Prompts, drafts, variables that people add, budgets of templates and snippets, files read again, providers by settings."""

import json

import pytest
from pyspark.sql import functions as F

from parchment.operators import budget, chatlog, providers
from parchment.plans import drafting
from parchment.sources import files

DOCS = "project_id string, id long, category string, file_key string, file_name string, text_content string"
VARIABLES = "project_id string, var_key string, file_key string, affects string, label string, action string, value_text string, sort_order int, confirmed boolean"


def test_templates(spark):
    long = "opening " * 200 + "x" * 8000 + "Guidance" + "y" * 1000
    rows = [("p", 1, "STANDARD_TEMPLATE", "NTT", "a", "short"), ("p", 2, "STANDARD_TEMPLATE", "SCT", "b", long), ("p", 3, "PROJECT_INPUT", None, "c", "no template"), ("p", 4, "STANDARD_TEMPLATE", "SCC", "d", " "), ("q", 5, "PROJECT_INPUT", None, "e", "text")]
    got = {r.project_id: r.templates for r in budget.templates(spark.createDataFrame(rows, DOCS)).collect()}
    at = long.index("Guidance")
    assert got == {"p": "=== a ===\nshort\n\n=== b ===\n" + long[:1800] + "\n...[已截断]" + budget.LEFT_OUT + long[at - 300 : at + 500]}


def test_snippets_stop_at_the_budget(spark):
    rows = [("p", 1, "PROJECT_INPUT", None, "a.txt", "nothing\nbill number one\n bill \n"), ("p", 2, "PROJECT_INPUT", None, "b.txt", "tender a " * 9), ("q", 3, "PROJECT_INPUT", None, "c", None)]
    got = {r.project_id: r.snippets for r in budget.snippets(spark.createDataFrame(rows, DOCS), 60).collect()}
    # 9 + 18 + 9 characters leave 24 of 60
    assert got == {"p": "[a.txt]\n  bill number one\n\n[b.txt]\n  tender a tender a tend", "q": budget.NO_SNIPPETS} and len("\n" + got["p"]) <= 60


def test_draft(spark):
    rows = [("p", "k1", "NTT", None, "One", "fill", "v", 2, True), ("p", "k0", None, "NTT,SCC", "Zero", "fill", None, 1, True), ("q", "k", "NTT", None, "x", "fill", "v", 1, False)]
    docs = spark.createDataFrame([("p", 1, "STANDARD_TEMPLATE", "NTT", "n", "the template"), ("p", 2, "PROJECT_INPUT", "SCC", "s", "no template")], DOCS)
    chat = lambda p: json.dumps({"title": "t", "content": p}) if "Tenderers" in p else "{}"
    found = drafting.draft(spark.createDataFrame(rows, VARIABLES), docs, F.lit("C1"), chat).collect()
    got = {(r.project_id, r.doc_key): r.content for r in found}
    assert sorted(got) == [("p", "NTT"), ("p", "SCC"), ("p", "SCT")]
    head, listed, template = got["p", "NTT"].split("\n\n")[:3]
    assert head == "Notes to Tenderers / C1" and template == "the template"
    assert [v["key"] for v in json.loads(listed)] == ["k0", "k1"]
    assert got["p", "SCC"].startswith("## Special Conditions of Contract") and got["p", "SCT"].startswith("## Special Conditions of Tender")
    assert drafting.extraction_prompts(docs).first().prompt.count("the template") == 1


def test_create(spark):
    stored = spark.createDataFrame([("p", "old", 7)], "project_id string, var_key string, sort_order int")
    said = [("p", 1, "new key", " ntt "), ("p", 2, "old", "NTT"), ("p", 3, "!!", "NTT"), ("p", 4, "newkey", "NTT"), ("p", 5, "other", "AA"), ("q", 6, "first", "SCC"), ("p", 7, "last", "SCT")]
    df = spark.createDataFrame(said, "project_id string, pos long, key string, file_key string")
    for c in ("label", "action", "value", "affects", "source"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    got = {r.pos: r for r in drafting.create(stored, df.withColumn("options", F.array(F.lit(" a "), F.lit(" ")))).collect()}
    assert {i: r.error for i, r in got.items()} == {1: None, 2: 4008, 3: 4007, 4: 4008, 5: 4007, 6: None, 7: None}
    assert (got[1].var_key, got[1].file_key, got[1].action, got[1].sort_order) == ("newkey", "NTT", "fill", 8)
    assert got[7].sort_order == 9 and got[6].sort_order == 1


def test_parsed_again(spark):
    docs = spark.createDataFrame([(1, " ", "/x/a.txt", "FAILED"), (2, "own", "/x/b.txt", "PARSED"), (3, None, None, "PENDING")], "id long, text_content string, storage_path string, parse_status string")
    data = spark.createDataFrame([("/x/a.txt", b"said"), ("/x/b.txt", b"other")], "path string, content binary")
    got = {r.id: (r.text_content, r.parse_status) for r in files.parsed_again(docs, data).collect()}
    assert got == {1: ("said", "PARSED"), 2: ("own", "PARSED"), 3: (None, "PENDING")}


def test_log_goes_on(spark):
    answers = spark.createDataFrame([("p", 5, "q?", False, None, ["a"], "tender", "chunk:L", None), ("p", 6, "lost", None, None, None, None, None, 4203)], "project_id string, pos long, question string, grounded boolean, answer string, citations array<string>, scope string, evidence_id string, error int")
    log = spark.createDataFrame([("p", 9), ("r", 1)], "project_id string, id long")
    new = chatlog.entries(answers, log)
    assert sorted((r.id, r.role, r.title, r.content, r.unknown_scope, r.evidence_id) for r in new.collect()) == [(10, "user", None, "q?", None, None), (11, "assistant", "I don't know", None, "tender", "chunk:L")]
    assert chatlog.clear(new, log.where("project_id = 'p'")).count() == 0


def test_chosen():
    assert providers.chosen({}) == (None, providers.stub_embed)
    with pytest.raises(ValueError):
        providers.chosen({"kind": "other"})


def test_embedder_sends_one_by_one_where_a_list_fails(monkeypatch):
    sent = []

    class Said:
        def __init__(self, body):
            self.body = body

        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def read(self):
            return self.body

    def urlopen(request, timeout):
        texts = json.loads(request.data)["input"]
        sent.append(texts)
        if len(texts) > 1:
            raise OSError("too long")
        return Said(json.dumps({"embeddings": [[float(len(texts[0]))]]}))

    monkeypatch.setattr(providers.urllib.request, "urlopen", urlopen)
    assert providers.http_embed("http://x", "m")(["a", "bb"]) == [[1.0], [2.0]] and sent == [["a", "bb"], ["a"], ["bb"]]


RECORDS = "project_id string, pos long, key string, scope string, file_key string, label string, action string, value string, affects string, source string, confidence double"


def test_extraction_order(spark):
    """Confirmed keys take no place, repeats take one each and the last one wins; invented base keys of any case go."""
    rows = [
        ("p", 1, "K1", "FILE", "NTT", "a", "fill", "v", None, None, 0.9),
        ("p", 2, "K2", "file", "NTT", "b", " Choice", "pick me", None, None, None),
        ("p", 3, "made", "base", None, "c", "fill", "v", None, None, 0.9),
        ("p", 4, "K3", None, "sct", "d" * 600, "odd", None, "ntt,zz", "s" * 500, 0.9),
        ("p", 5, "K2", "FILE", "NTT", "b2", "Choice", "other", None, None, 0.9),
        ("p", 6, "fundingarrangement", "FILE", "SCC", "x", "fill", "tender b (both)", None, None, 0.0),
        ("p", 7, "K4", "FILE", "NTT", "e", "fill", "v", None, None, 0.5),
    ]
    stored = spark.createDataFrame([("p", "K1", "FILE", "old", True), ("p", "K4", "FILE", "old", False), ("p", "K9", "FILE", "old", None)], "project_id string, var_key string, scope string, value_text string, confirmed boolean")
    for c in ("choice", "source_ref", "label", "action", "affects", "kind", "file_key"):
        stored = stored.withColumn(c, F.lit(None).cast("string"))
    df = spark.createDataFrame(rows, RECORDS).withColumn("options", F.array().cast("array<string>"))
    got = {r.var_key: r for r in drafting.reconcile(df, stored.withColumn("sort_order", F.lit(5))).collect()}
    own = {k for k in got if k.startswith("K")}
    assert own == {"K1", "K2", "K3"} and "made" not in got and len(got) == 3 + 8 + 1
    assert (got["K1"].sort_order, got["K1"].value_text) == (5, "old")
    assert (got["K2"].sort_order, got["K2"].choice, got["K2"].action, got["K2"].label) == (1002, "other", "choice", "b2")
    assert (got["K3"].sort_order, got["K3"].file_key, got["K3"].action, got["K3"].value_text, got["K3"].affects) == (1001, "SCT", "fill", "", "NTT")
    assert got["K3"].label.startswith("d" * 480) and not got["K3"].label.startswith("d" * 481) and got["K3"].source_ref.startswith("s" * 480)
    base = got["fundingarrangement"]  # a row of its own, as keys are compared as they are
    assert (base.scope, base.file_key, base.choice, base.sort_order, base.label) == ("BASE", None, "Tender B", 2, "Tender A / B Funding Arrangement")
    assert {r.sort_order for k, r in got.items() if r.scope == "BASE" and k != "fundingarrangement"} == set(range(8))


def test_unconfirmed_is_not_settled(spark):
    rows = [("p", "a", "NTT", None, "A", "fill", "v", 1, None), ("q", "b", "NTT", None, "B", "fill", "v", 1, True)]
    got = {(r.project_id, r.doc_key): r.content for r in drafting.generate(spark.createDataFrame(rows, VARIABLES), F.lit("C1")).collect()}
    assert sorted(got) == [("q", "NTT"), ("q", "SCC"), ("q", "SCT")] and "- **B**" in got["q", "NTT"] and "**" not in got["q", "SCC"].split("C1")[1]
