"""Golden values of text functions, chunks, names, JSON repair, merges and budgets."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from parchment.functions import jsontext, naming, text
from parchment.operators import budget, findings, merge, providers, sourceset
from parchment.operators.chunk import page_estimate, split


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def chunks(spark, texts, size=800, overlap=120):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", split(F.col("t"), size, overlap).alias("c"))
    return [r.c for r in df.orderBy("i").collect()]


def test_chunks(spark):
    said = {
        "aaaa\n\nbbbb\n\ncccc": ["aaaa\n\nbbbb", "bb\n\n\n\ncccc"],
        "abcdefghijklmnopqrstuvwxyz": ["abcdefghijkl", "ijklmnopqrst", "qrstuvwxyz"],
        "aa\n\nabcdefghijklmnopqrst\n\nzz": ["aa", "abcdefghijkl", "ijklmnopqrst", "zz"],
        "abcdefghijk\n\nzz": ["abcdefghijk", "jk\n\n\n\nzz"],
        "": [],
        None: [],
    }
    assert chunks(spark, said, 12, 4) == list(said.values())


def test_chunk_sizes(spark):
    got = chunks(spark, ["\n\n".join(["x" * 300] * 5), "y" * 2000])
    assert [[len(c) for c in g] for g in got] == [[602, 724, 422], [800, 800, 640]]


def test_chunks_of_many_paragraphs(spark):
    """Twenty thousand paragraphs; twice as many take about twice as long, not four times."""
    said = "\n\n".join(f"paragraph {i} " + "x" * (i % 90) for i in range(20_000))
    assert chunks(spark, [said])[0] == plain_chunks(said, 800, 120)
    spent = []
    for n in (10_000, 40_000):
        text_ = "\n\n".join(f"paragraph {i}" for i in range(n))
        df = spark.createDataFrame([(text_,)], "t string").select(F.size(split(F.col("t"))).alias("n"))
        began = time.time()
        df.collect()
        spent.append(time.time() - began)
    assert spent[1] < 9 * max(spent[0], 0.3)


def plain_chunks(said: str, size: int, overlap: int) -> list[str]:
    """The rule on a list of paragraphs, by index."""
    edge = "".join(map(chr, range(33)))
    todo, out, held = [p for p in (x.strip(edge) for x in re.split(r"\n{2,}", said)) if p], [], ""
    for p in todo:
        if len(p) > size:
            out.append(held)
            out += [p[i : i + size] for i in range(0, len(p), size - overlap) if i == 0 or i + overlap < len(p)]
            held = ""
        else:
            if len(held) + len(p) + 2 > size:
                out.append(held)
                held = held[max(0, len(held) - overlap) :] + "\n\n"
            held += p + "\n\n"
    return [c if len(c) == size else c.strip(edge) for c in [*out, held] if c.strip(edge)]


def test_chunks_of_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\n") for _ in range(rng.randrange(200))) for _ in range(300)]
    got = chunks(spark, texts, 20, 5)
    for text, own in zip(texts, got):
        assert [c.strip() for c in own] == [c.strip() for c in plain_chunks(text, 20, 5)]
        assert all(word in " ".join(own) for word in text.split() if len(word) <= 20 and len(text) > 0 and max(map(len, text.split("\n\n"))) <= 20)


def test_pages(spark):
    found = one(spark, *[page_estimate(F.lit(i), F.lit(4), F.lit(10)) for i in range(4)])
    assert found == ("P3", "P5", "P8", "P10")


@pytest.mark.parametrize(
    "said, needle, at",
    [
        ("See NTT 3(b) here", "NTT3(b)", 3),
        ("See NTT3(b) here", "NTT 3(b)", 3),
        ("x NTT3(b)", "NTT 3(b)", 1),
        ("xNTT3(b)", "NTT 3(b)", -1),
        ("A SCC 4.1", "scc 4.1", 2),
        ("abc", "zz", -1),
        ("", "a", -1),
        (None, "a", -1),
        ("abc", " ", -1),
        ("É t é x", "ÉTÉ", 0),
    ],
)
def test_find_loose(spark, said, needle, at):
    df = spark.createDataFrame([(said, needle)], "t string, n string")
    assert df.select(text.find_loose(F.col("t"), F.col("n"))).first()[0] == at


def _literal(said: str, needle: str) -> int:
    """The rule read out: two fingers over both, white space skipped."""
    pin = needle.strip()
    if not said.strip() or not pin:
        return -1
    direct = said.lower().find(pin.lower())
    if direct >= 0:
        return direct
    for start in range(len(said) - len(pin) + 1):
        i, j = start, 0
        while j < len(pin):
            if pin[j].isspace():
                j += 1
                continue
            while i < len(said) and said[i].isspace():
                i += 1
            if i >= len(said) or said[i].lower() != pin[j].lower():
                break
            i, j = i + 1, j + 1
        else:
            return start
    return -1


def test_find_loose_on_random_strings(spark):
    import random

    rng = random.Random(5)
    rows = [("".join(rng.choice("ab (") for _ in range(rng.randint(0, 12))), "".join(rng.choice("ab (") for _ in range(rng.randint(0, 4)))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string, n string")
    found = df.select("t", "n", text.find_loose(F.col("t"), F.col("n")).alias("at")).collect()
    assert [r for r in found if r["at"] != _literal(r["t"], r["n"])] == []


def test_page_at(spark):
    said = "--- P1 ---\nab--- P12 ---cd"
    assert one(spark, *[text.page_at(F.lit(said), F.lit(i)) for i in (0, 5, said.index("--- P12"), len(said))]) == ("P1", "P1", "P12", "P12")
    assert one(spark, text.page_at(F.lit("x--- P3 ---"), F.lit(0)))[0] is None


def test_normalize_and_html(spark):
    assert one(spark, text.normalize(F.lit(" a\r\nb\rc \t d\n\n\n\ne\n \n \n"))) == ("a\nb\nc d\n\ne",)
    assert one(spark, text.normalize(F.lit(None).cast("string"))) == ("",)
    assert one(spark, text.normalize(text.strip_html(F.lit("<style>x</style><p>a&nbsp;b</p>c<br/>d&amp;lt;")))) == ("a b\nc\nd<",)


@pytest.mark.parametrize(
    "name, key",
    [("04_Form of Tender.pdf", None), ("06_x (GCC).pdf", "GCC"), ("General Specification.pdf", "SL"), ("PSS - Preliminaries (PRE).docx", "PRE"), ("Draft.pdf", "FT"), ("Translation.docx", "SL"), ("Notes to Tenderers.docx", "NTT"), ("memo.txt", None), (None, None)],
)
def test_file_keys(spark, name, key):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(naming.match_file_key(F.col("n"))).first()[0] == key


def test_template_keys(spark):
    names = ["06_General Conditions of Contract (GCC).pdf", "04_Form of Tender.pdf", "memo.txt"]
    assert one(spark, *[naming.match_template_key(F.lit(n)) for n in names]) == ("SCC", "NTT", "NTT")


def test_groups(spark):
    said = [("f2-v", "language"), ("f2-i", "conflict"), ("f2-iv,f2-i", "reference"), ("f2-ii", "risk"), ("", "risk"), ("f2-v,f2-viii", "conflict"), ("x", "risk")]
    assert one(spark, *[naming.group_of(F.lit(t)) for t, _ in said]) == tuple(g for _, g in said)


def test_needles(spark):
    null = F.lit(None).cast("string")
    assert one(spark, text.needles_of(null, F.lit("NTT 3(b)"), F.lit("NTT3(b) → SCT26")))[0] == ["NTT 3(b)", "NTT3(b) → SCT26", "NTT3(b)", "SCT26"]
    assert one(spark, text.needles(null, F.lit("NTT 3(b)"), F.lit("NTT3(b) → SCT26"), F.lit("SCT20")))[0] == ["NTT 3(b)", "NTT3(b)", "SCT26", "SCT20"]


@pytest.mark.parametrize(
    "said, value",
    [
        ('[{"a":1}]', ['{"a": 1}']),
        ('```json\n{"items":[1,2]}\n```', ["1", "2"]),
        ('so {"findings": [{"x": "}]"}]} done', ['{"x": "}]"}']),
        ('[{"items":[1]},{"items":[2]}]', ["1", "2"]),
        ('{"a": "\\"}"}', None),
        ("nothing", None),
        ('{"items": [1', None),
        (None, None),
    ],
)
def test_json_items(said, value):
    assert jsontext.items(said) == value


@pytest.mark.parametrize(
    "said, value",
    [
        ("x {a [b", "{a [b"),
        ('```json\n{"a":1}\n``` done ``', '{"a":1}'),
        ("no brackets", "no brackets"),
        ("```\nno\n```", "no"),
        ('```json\n{"a":[1\n```', '{"a":[1'),
        ('x {"a":"}\\""} y', '{"a":"}\\""}'),
        ('["a]","b"] z', '["a]","b"]'),
        ('{"a": "not closed } ', '{"a": "not closed }'),
        ("", ""),
        (None, None),
    ],
)
def test_first_value(said, value):
    assert jsontext.first_value(said) == value


def test_fences(spark):
    said = ["```json\nx\n``` done", "```\na```b```c", "```", "```x", " y ", "x ```", None, "````\nq\n````"]
    assert list(one(spark, *[jsontext.strip_fence(F.lit(t).cast("string")) for t in said])) == ["x", "a```b", "", "", "y", "x ```", "", "q\n`"]


def test_blanks_around_a_file_key(spark):
    assert one(spark, *[naming.file_key(F.lit(k).cast("string")) for k in ("ntt", " ntt ", "zzz", "", None)]) == ("NTT", None, None, None, None)


def test_ocr():
    said = '{"r": [{"text": "a", "score": 0.5, "bbox": [[1, 2], [3, 5]]}, {"rec_text": " "}, {"transcription": "b", "points": [{"x": 1, "y": 1}]}]}'
    assert jsontext.ocr_lines(said) == [{"text": "a", "confidence": 0.5, "bbox": {"x": 1.0, "y": 2.0, "w": 2.0, "h": 3.0}}, {"text": "b", "confidence": 1.0, "bbox": {"x": 1.0, "y": 1.0, "w": 0.0, "h": 0.0}}]
    odd = '{"b": [{"text": 12.5, "score": "0.5", "points": [{"x": "1", "y": 2}]}, {"transcription": "x", "confidence": "much", "bbox": [[1]]}], "a": {"text": {"text": "in"}}, "c": {"text": true, "rec_score": 1}, "d": {"text": " "}}'
    assert [(x["text"], x["confidence"], x["bbox"]) for x in jsontext.ocr_lines(odd)] == [("12.5", 0.5, {"x": 1.0, "y": 2.0, "w": 0.0, "h": 0.0}), ("x", 1.0, None), ("true", 1.0, None)]
    deep = "[" * 8 + '{"text": "in"}' + "]" * 8
    assert len(jsontext.ocr_lines(deep)) == 1 and jsontext.ocr_lines(f"[{deep}]") == []
    assert jsontext.ocr_lines(None) == jsontext.ocr_lines("{") == []


def test_choices(spark):
    options = F.array(*map(F.lit, ("Tender A", "Tender B")))
    assert one(spark, *[naming.choice_of(naming.normalize_choice(F.lit(v), options), options) for v in ("tender b (x)", "z Tender B", "other", "")]) == ("Tender B", "Tender B", "Tender A", None)
    assert one(spark, *[naming.normalize_list(F.lit(v)) for v in ("a\\nb", '["x"]', " ", "a\n\n b ")]) == ('["a","b"]', '["x"]', "[]", '["a","b"]')


def test_first_wins_and_cap(spark):
    rows = [("p", i, "f2-ii", f"t{i}") for i in range(12)] + [("p", 12, "f2-i", "c"), ("p", 13, "f2-i", "c"), ("p", 14, " ", "d"), (None, 1, "f2-i", "n")]
    df = spark.createDataFrame(rows, "project_id string, pos long, types string, title string")
    for c in ("refs", "location", "quote", "scope", "severity", "file_key", "bucket_key", "expected", "page_no"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    kept = {(r.project_id, r.pos): r for r in findings.accept(df).collect()}
    assert sorted(k[1] for k in kept if k[0]) == [*range(10), 12]
    assert kept["p", 12].code == "VT-011" and kept[None, 1].code == "VT-001" and kept["p", 12].scope == "inter"
    counts = {r.project_id: r for r in findings.run_counts(df).collect()}
    assert (counts["p"].said, counts["p"].blank, counts["p"].repeated, counts["p"].over_cap) == (15, 1, 1, 2)


def test_numbers_run_over_slices(spark):
    df = spark.range(10_000).select(F.lit("p").alias("project_id"), (F.col("id") * 3).alias("pos"))
    got = findings.numbered(df, "project_id", "pos").orderBy("pos").select("nth").collect()
    assert [r.nth for r in got] == list(range(1, 10_001))


def test_tiers(spark):
    rows = [(1, "a", "VETTING_PACKAGE", "NTT", "PARSED", "x"), (2, "a", "PROJECT_INPUT", "SCT", "PARSED", "x"), (3, "b", "PROJECT_INPUT", "SCT", "PARSED", "xx"), (4, "b", "PROJECT_INPUT", "SCT", "PARSED", "yy"), (5, "c", "PROJECT_INPUT", None, "PARSED", "x"), (6, "d", "VETTING_PACKAGE", None, "FAILED", "x")]
    df = spark.createDataFrame(rows, "id long, project_id string, category string, file_key string, parse_status string, text_content string")
    assert sorted((r.id, r.tier) for r in sourceset.reviewable(df).collect()) == [(1, 1), (3, 2), (5, 4)]


def test_merge_keeps_locked_rows(spark):
    old = spark.createDataFrame([("a", 1, True), ("b", 2, False), ("c", 3, None)], "k string, v int, confirmed boolean")
    new = spark.createDataFrame([("a", 10), ("b", 20), ("d", 40)], "k string, v int")
    got = {r.k: (r.v, r.outcome) for r in merge.upsert(old, new, ["k"], F.col("confirmed"), ["v"]).collect()}
    assert got == {"a": (1, "kept"), "b": (20, "updated"), "c": (3, "kept"), "d": (40, "inserted")}


def test_spans_are_disjoint(spark):
    rows = [("k", 0, 0, 5), ("k", 1, 5, 7), ("k", 2, 9, 10), ("k", 3, 1, 2), ("j", 0, 3, 4)]
    got = sorted(tuple(r) for r in budget.merged_spans(spark.createDataFrame(rows, "k string, pos int, start int, end int"), ["k"]).collect())
    assert got == [("j", 3, 4, 1), ("k", 0, 7, 3), ("k", 9, 10, 1)]


def test_focus(spark):
    said = "x" * 1000 + "Guidance" + "y" * 1000
    df = spark.createDataFrame([(1, said), (2, "z" * 50), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.focused for r in budget.focused(df, 900).collect()}
    assert got[1] == said[700:1500] and got[2] == "z" * 50 and got[3] == ""


def test_prompts():
    assert providers.format_prompt("a %s b %s", "1", "2") == "a 1 b 2"
    assert providers.format_prompt("a %s", "1", "2") == "a 1\n2"
    assert providers.format_prompt("a %s %s", "1") == "a 1 %s"


def test_completion_asks_twice(spark):
    asked = spark.createDataFrame([("good",), ("bad",)], "prompt string")
    chat = lambda p: '{"a": 1}' if p.startswith("good") else "no"
    got = {r.prompt: (r.answer, r.error) for r in providers.complete_json(asked, chat).collect()}
    assert got["good"] == ('{"a": 1}', None) and got["bad"][1].startswith("5002")
